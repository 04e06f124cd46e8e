"""The queries of problems 6 to 8 over the project's tables. Their work is beyond SQL; tests hold them to brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, packing, pii, tokens
from tidemark.storage import written


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """The posts, in as many partitions as there are task slots at least: their texts are handled in Python."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    slots = spark.sparkContext.defaultParallelism
    return docs.repartition(3 * slots) if docs.rdd.getNumPartitions() < slots else docs


def _places(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokens.sized(_documents(spark, d)))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.cut_documents(_places(spark, d))


def p6_places(spark: SparkSession, d: str) -> DataFrame:
    return _places(spark, d).select("doc_id", "piece", "start_token", "n_tokens", "container")


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Fill of every container, and how far it is off the proportions of the sources."""
    return packing.containers(written(_places(spark, d), "places"))


def p6_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Tokens, target and carried account of each source in each container."""
    return packing.mixture(written(_places(spark, d), "places")).select("container", "source", "n_tokens", "target_tokens", "carried")


def p6_placed(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is placed, whole: texts, tokens missing between and after the pieces, and overfull containers it is in."""
    sized = written(tokens.sized(_documents(spark, d)), "sized")
    places = written(packing.pack(sized), "places")
    over = packing.overfull(places).select(F.col("container").alias("_c"), F.lit(1).alias("over"))
    placed = places.join(over, F.col("container") == F.col("_c"), "left").groupBy("doc_id").agg(
        F.count_if(F.col("piece") == 0).alias("n_texts"), F.sum("n_tokens").alias("_placed"), F.count("over").alias("n_overfull")
    )
    had = sized.groupBy(F.col("doc_id").alias("_d")).agg(F.sum("n_tokens").alias("_had"))
    out = placed.join(had, F.col("doc_id").eqNullSafe(F.col("_d")))
    return out.select("doc_id", "n_texts", (F.col("_had") - F.col("_placed")).alias("n_missing"), "n_overfull")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(tokens.sized(_documents(spark, d)), spark.read.parquet(f"{d}/mix_targets.parquet"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(tokens.sized(_documents(spark, d)), spark.read.parquet(f"{d}/mix_targets.parquet"))[1]


def p7_limits(spark: SparkSession, d: str) -> DataFrame:
    """For each target the texts that its source has, and how many of its documents break a rule of the mix.

    Rules: no document oftener than ``max_repeats``, none of another source, shares reached that add up to one.
    """
    targets = spark.read.parquet(f"{d}/mix_targets.parquet")
    sized = written(tokens.sized(_documents(spark, d)), "sized")
    mixed, shares = mixing.mix(sized, targets)
    limits = shares.select(F.col("source").alias("_s"), F.col("max_repeats").alias("_most"))
    mixed = mixed.join(limits, F.col("source") == F.col("_s"), "left")
    bad = mixed.where(F.col("_most").isNull() | (F.col("copies") > F.col("_most"))).groupBy(F.col("source").alias("_b")).agg(F.count(F.lit(1)).alias("n_bad"))
    had = sized.where("n_tokens > 0").groupBy(F.col("source").alias("_h")).agg(F.count(F.lit(1)).alias("n_texts"))
    whole = shares.agg(F.round(F.sum("reached_share"), 9)).scalar()
    out = shares.join(had, F.col("source") == F.col("_h"), "left").join(bad, F.col("source") == F.col("_b"), "left")
    return out.select("source", "max_repeats", F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.coalesce("n_bad", F.lit(0)).alias("n_bad"), whole.alias("shares_add_up_to"))


def _found(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = _documents(spark, d)
    return docs, pii.find_personal_information(docs, spark.read.parquet(f"{d}/given_names.parquet"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d)[1].select("doc_id", "kind", F.col("start_at").cast("long").alias("start_at")).distinct()


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    docs, found = _found(spark, d)
    return pii.redact(docs, found).select("doc_id", "text")


def p8_ways(spark: SparkSession, d: str) -> DataFrame:
    """How many pieces of each kind were found by form, seed, street or pattern."""
    return _found(spark, d)[1].groupBy("kind", "way").agg(F.count(F.lit(1)).alias("n"))


def p8_held_out(spark: SparkSession, d: str) -> DataFrame:
    """Names found although their given name is withheld from the list."""
    return pii.held_out(_documents(spark, d), spark.read.parquet(f"{d}/given_names.parquet"))


QUERIES = {f.__name__: f for f in (p6_found, p6_places, p6_containers, p6_mixture, p6_placed, p7_mix, p7_shares, p7_limits, p8_found, p8_redacted, p8_ways, p8_held_out)}
SQL = {
    "p6_placed": "SELECT doc_id, count(*) AS n_texts, CAST(0 AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_overfull FROM documents WHERE text <> '' GROUP BY 1",
    "p7_limits": """SELECT t.source, t.max_repeats, count(d.text) AS n_texts, CAST(0 AS BIGINT) AS n_bad, CAST(1 AS DOUBLE) AS shares_add_up_to FROM mix_targets t
  LEFT JOIN documents d ON regexp_replace(lower(trim(d.source)), '[\\s_-]+', '-', 'g') = t.source AND d.text <> '' GROUP BY 1, 2""",
}
