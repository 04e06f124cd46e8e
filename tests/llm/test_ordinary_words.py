"""Ordinary words are told by their share of all words, however many there are."""

from tidemark.llm import pii


def test_no_ordinary_word_is_cut(spark):
    counts = spark.range(25_000).selectExpr("concat('w', id) AS word", "100L AS n", "100L AS small")
    rare = spark.createDataFrame([("rare", 4, 4), ("Capital", 100, 10)], "word string, n long, small long")
    words = pii.ordinary_words(counts.unionByName(rare))
    assert words == {f"w{i}" for i in range(25_000)}
