"""Batches as JSON: one value a batch, which holds all of its puts."""

from tidemark.plans import store_queries


def test_one_json_value_a_batch(spark, tmp_path):
    rows = [(1, 0, 1, "a", "x"), (1, 1, 1, "b", "y"), (1, 2, 1, "a", "z"), (1, 2, 1, "a", "z"), (1, 3, 0, "b", None), (2, 0, 1, 'q"', "{é}"), (2, 1, 1, None, "v"), (3, 0, 0, "a", None)]
    spark.createDataFrame(rows, "batch_no long, ordinal long, op int, user_key string, value string").write.parquet(f"{tmp_path}/batch.parquet")
    text = {r.batch_no: r.json for r in store_queries._json_of_batches(spark.read.parquet(f"{tmp_path}/batch.parquet")).collect()}
    assert set(text) == {1, 2}
    assert text[1] == '[{"user_key":"a","value":"x"},{"user_key":"a","value":"z"},{"user_key":"b","value":"y"}]'
    back = sorted(tuple(r) for r in store_queries.json_batches(spark, str(tmp_path)).collect())
    assert back == [(1, "a", "x"), (1, "a", "z"), (1, "b", "y"), (2, 'q"', "{é}")]
