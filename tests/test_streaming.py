from tidemark.streaming import ingest

SCHEMA = "user_key string, seq long, op int, value string"


def feed(spark, tmp_path):
    for i, rows in enumerate([[("a", 1, 1, "x"), ("b", 2, 1, "y"), ("b", 5, 0, None)], [("a", 3, 1, "z"), ("b", 4, 1, "late"), (None, 9, 1, "n")], [("a", 3, 1, "z"), ("c", 7, 1, ""), ("c", 8, 7, "bad")]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/feed/{i}")
    path = f"file://{tmp_path}/all"
    spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/feed").repartition(3).write.parquet(path)
    return path


def test_patches_of_micro_batches(spark, tmp_path):
    got = ingest.latest_of_files(spark, feed(spark, tmp_path), max_files=1)
    assert sorted(map(tuple, got.collect())) == [("a", 3, "z"), ("c", 7, "")]


def test_micro_batches_bounded_by_bytes(spark, tmp_path):
    path, numbers = feed(spark, tmp_path), []
    stream = ingest.read_changes(spark, path, SCHEMA, max_bytes=1)
    ingest.run_to_end(stream, lambda df, n: numbers.append(n), f"file://{tmp_path}/ck")
    assert numbers == [0, 1, 2]


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    table = ingest.PatchTable(spark, f"file://{tmp_path}/p")
    batch = spark.createDataFrame([("a", 1, 1, "x")], SCHEMA)
    table.write(batch, 0)
    table.write(batch, 0)
    table.write(spark.createDataFrame([("a", 2, 0, None)], SCHEMA), 1)
    assert table.state().count() == 0


def test_patches_are_merged(spark, tmp_path):
    table = ingest.PatchTable(spark, f"file://{tmp_path}/p", merge_every=3)
    want = {}
    for n in range(9):
        rows = [(f"k{n % 4}", 10 * n, 1, f"v{n}"), (f"k{(n + 1) % 4}", 10 * n + 1, 0, None), ("old", 1, 1, "x")]
        table.write(spark.createDataFrame(rows, SCHEMA), n)
        for k, s, o, v in rows:
            if s >= want.get(k, (-1,))[0]:
                want[k] = (s, o, v)
        assert {r.user_key: r.seq for r in table.state().collect()} == {k: s for k, (s, o, _) in want.items() if o}
    assert len(table.files.folders()) <= 4
    table.write(spark.createDataFrame([("k0", 999, 1, "again")], SCHEMA), 2)  # merged before
    assert 999 not in {r.seq for r in table.state().collect()}


def test_stateful_view_keeps_deletes(spark, tmp_path):
    stream = ingest.newest_by_key(ingest.read_changes(spark, feed(spark, tmp_path), SCHEMA, max_files=1))
    seen = {}

    def each(df, _):
        for r in df.collect():
            assert seen.get(r.user_key, (-1,))[0] < r.seq
            seen[r.user_key] = (r.seq, r.op, r.value)

    query = stream.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    assert seen == {"a": (3, 1, "z"), "b": (5, 0, None), "c": (7, 1, "")}
