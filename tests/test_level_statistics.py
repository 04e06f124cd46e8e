"""The statistics query says what load and compaction did."""

from tidemark.plans import store_queries
from tidemark.store import Options


def test_statistics_follow_load_and_compaction(spark, monkeypatch):
    monkeypatch.setattr(store_queries, "Options", lambda **kw: Options(max_file_bytes=50_000, **kw))
    rows = store_queries.store_level_statistics(spark, "/root/testdata/sf0.001").collect()
    assert [r.level for r in rows] == list(range(7))
    assert rows[0].n_files == 0 and sum(r.n_files for r in rows) >= 1
    assert all((r.n_bytes > 0) == (r.n_files > 0) for r in rows)
    assert sum(r.bytes_read for r in rows) > sum(r.bytes_written for r in rows) > 0
