"""Pending work processed through the ledger of leases."""

import datetime as dt

from tidemark.operators.incremental import WorkLedger, process_pending


def test_ledger_holds_the_runs_and_the_lease(spark, tmp_path):
    day = lambda n: dt.datetime(2027, 3, n)
    runs = spark.createDataFrame([(1, "succeeded", day(2), day(2)), (2, "failed", day(3), day(4)), (3, "running", day(5), day(5))], "run_id long, status string, read_upto timestamp, logged_at timestamp")
    headers = spark.createDataFrame([(1, 10, day(1)), (2, 20, day(3)), (3, 30, day(6))], "batch_no long, starting_seq_number long, arrived_at timestamp")
    elements = spark.createDataFrame([(n, 0, 1, "k", "v") for n in (1, 2, 3)], "batch_no long, ordinal int, op int, user_key string, value string")
    root = f"file://{tmp_path}/ledger"
    done = process_pending(spark, root, headers, elements, runs)
    assert sorted(r.seq for r in done.collect()) == [20, 30]
    assert sorted(r.seq for r in process_pending(spark, root, headers, elements, runs).collect()) == [20, 30]
    ledger = WorkLedger(spark, root)
    assert [e["kind"] for e in ledger.events()] == ["lease", "done", "lease", "released", "lease", "lease", "done"]
    assert ledger.done_upto() == "2027-03-06 00:00:00"
    assert "out/" in done.inputFiles()[0]
