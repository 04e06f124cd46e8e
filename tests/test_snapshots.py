"""Snapshots taken from the data see the same part of a log of any size."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck


@pytest.fixture(params=[300, 30_000])
def log(spark, tmp_path, request):
    """Puts only, each key twice: in either half once, 100 keys in each half's last tenth."""
    n = request.param
    rows = spark.range(1, n + 1).selectExpr(f"concat('k', lpad((id - 1) % {n // 2}, 6, '0')) AS user_key", "id AS seq", "CAST(1 AS INT) AS op", "concat('v', id) AS value", "CAST(0 AS BIGINT) AS file_number")
    rows.write.parquet(f"{tmp_path}/oplog.parquet")
    return n, str(tmp_path)


@pytest.mark.parametrize("name, part", [("scan_half", 0.5), ("range_scan_newest", 0.5), ("diff_half_newest", 0.5), ("compact_keep_recent", 0.6), ("compact_recent_then_scan", 0.5), ("compact_recent_then_scan_snapshot", 0.5)])
def test_covers_the_same_part_of_any_log(spark, log, name, part):
    n, d = log
    assert entry.queries()[name](spark, d).count() == n * part
    assert compare(spark, d, entry.queries()[name], entry.oracle_sql()[name], duck(d)) is None


def test_snapshots_cut_the_smallest_tables(spark):
    """Each of them sees, drops or differs by something, but not by everything."""
    d = "/root/testdata/sf0.001"
    count = lambda name: entry.queries()[name](spark, d).count()
    assert 0 < count("diff_half_newest") < count("scan_live")
    assert count("compact_keep_recent") < count("key_text")
    assert count("scan_half") != count("scan_live")
