import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import compaction, incremental, order, reads, seen, skew, smallfiles, versions, writes
from tidemark.operators.incremental import StaleLease, WorkLedger
from tidemark.storage import registered, scratch


# --- has this key been seen before


@pytest.mark.parametrize("batches", [None, [20, 60]])
def test_seen_before(spark, batches):
    r = random.Random(1)
    keys = ["hot"] * 20 + ["", "a", "A", "é", None] + [f"k{i}" for i in range(20)]
    probes = [(i, r.choice(keys), "x") for i in range(100)]
    probes += r.choices(probes, k=20)
    r.shuffle(probes)
    past = [("a", "y"), ("a", "y"), (None, "y"), ("k3", "y"), ("unasked", "y")]
    known, want = {k for k, _ in past if k is not None}, set()
    for i, k, _ in sorted(set(probes), key=lambda p: p[0]):
        if k is None:
            continue
        if k in known:
            want.add(i)
        known.add(k)
    p = spark.createDataFrame(probes, "probe_id long, user_key string, _key string")
    h = spark.createDataFrame(past, "user_key string, _key string")
    got = seen.seen_before(p, h, buckets=3, batches=batches)
    assert sorted(x.probe_id for x in got.collect()) == sorted(want)


def test_seen_before_of_empty_tables(spark):
    p = spark.createDataFrame([], "probe_id long, user_key string")
    h = spark.createDataFrame([], "user_key string")
    assert seen.seen_before(p, h, buckets=2).count() == 0
    some = spark.createDataFrame([(2, "a"), (1, "a"), (None, "a"), (3, None)], "probe_id long, user_key string")
    assert [r.probe_id for r in seen.seen_before(some, h, buckets=2).collect()] == [2]


def test_ledger_answers_again_and_after_reopening(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    frame = lambda rows: spark.createDataFrame(rows, "probe_id long, user_key string")
    ask = lambda rows, no, n=8: sorted(map(tuple, seen.KeyLedger(spark, path, buckets=3, most_generations=n).ask(frame(rows), "user_key", "probe_id", no).select("user_key", "probe_id").collect()))
    seen.KeyLedger(spark, path, buckets=3).load(frame([(0, "old")]), "user_key")
    first = [(1, "x"), (2, "x"), (3, "old"), (4, None)]
    assert ask(first, "one") == [("x", 1)]
    assert ask(first, "one") == [("x", 1)]  # the job was lost and runs again
    assert ask([(5, "x"), (6, "y")], "two") == [("y", 6)]
    while registered:  # as in a new session
        spark.sql(f"DROP TABLE {registered.pop()}")
    assert ask([(7, "y"), (8, "old"), (9, "z")], "three", 2) == [("z", 9)]
    ledger = seen.KeyLedger(spark, path)
    assert len(ledger.history()) == 1 and ledger.buckets == 3  # merged
    ledger.clean()
    assert ask(first, "one") == [("x", 1)] and ask([(10, "z")], "four") == []


def test_a_batch_lost_before_its_manifest_is_asked_anew(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/ledger"
    batch = spark.createDataFrame([(1, "x")], "probe_id long, user_key string")
    with monkeypatch.context() as m:
        m.setattr(seen.KeyLedger, "_publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            seen.KeyLedger(spark, path, buckets=2).ask(batch, "user_key", "probe_id", "one")
    assert seen.KeyLedger(spark, path, buckets=2).ask(batch, "user_key", "probe_id", "one").count() == 1


# --- hot keys


def test_key_statistics(spark):
    data = [("a", 1, "xy", 5)] * 3 + [("a", 0, "é", 9), ("a", 7, None, None), (None, 1, "x", 1), ("", 1, "", 2)]
    df = spark.createDataFrame(data, "user_key string, op int, value string, seq long").withColumn("_size", F.lit(1))
    got = {r.user_key: tuple(r)[1:] for r in skew.key_statistics(df).collect()}
    assert got == {"a": (5, 3, 1, 8, 9), "": (1, 1, 0, 0, 2)}
    assert skew.key_statistics(df.limit(0)).count() == 0


def test_value_profile_against_brute_force(spark):
    r = random.Random(3)
    data = [("hot" if r.random() < 0.6 else r.choice("abc"), r.choice([None, "", "x" * r.randrange(5000), "y" * r.randrange(30)])) for _ in range(600)]
    got = {x.user_key: (x.n_values, x.mode_bytes, x.p50_bytes, x.p95_bytes) for x in skew.value_profile(spark.createDataFrame(data, "user_key string, value string")).collect()}
    for k in {k for k, v in data if v is not None}:
        values = [v for q, v in data if q == k and v is not None]
        sizes = sorted(map(len, values))
        top = Counter(sizes).most_common()
        mode = min(s for s, n in top if n == top[0][1])
        at = lambda p: sizes[max(1, -int(-len(sizes) * p // 1)) - 1]
        assert got[k] == (len(set(values)), mode, at(0.5), at(0.95))


def test_heavy_keys_share(spark):
    df = spark.createDataFrame([("t", "a")] * 99 + [("t", "b")] + [("u", "b")] * 2, "table_name string, user_key string").withColumns({"op": F.lit(1), "value": F.lit("v"), "seq": F.lit(1)})
    got = skew.heavy_keys(skew.key_statistics(df, group=["table_name"]), group="table_name")
    assert sorted((r.table_name, r.user_key) for r in got.collect()) == [("t", "a"), ("u", "b")]


def test_percentile_out_of_range_raises(spark):
    freq = spark.createDataFrame([("a", -1, 1)], "k string, v long, n_rows long")
    with pytest.raises(Exception, match="out of range"):
        skew.weighted_percentiles(freq, ["k"], "v", {"p": 0.5}).collect()


# --- new and changed records


def headers(spark, rows):
    return spark.createDataFrame(rows, "batch_no long, starting_seq_number long, arrived_at timestamp")


def test_pending_items(spark):
    from datetime import datetime

    t = lambda m: datetime(2027, 1, 1, 0, m)
    h = headers(spark, [(1, 10, t(1)), (1, 10, t(1)), (2, 12, t(5)), (3, 11, t(6)), (4, None, t(6)), (5, 50, None), (6, 20, t(9))])
    e = spark.createDataFrame([(1, 0, 1, "a", "v"), (1, 1, 1, None, "v"), (2, 0, 9, "b", None), (2, 0, 9, "b", None), (3, 0, 1, None, "v"), (3, 5, 1, "c", ""), (4, 0, 1, "x", "x"), (5, 0, 1, "x", "x"), (6, None, 1, "x", "x"), (7, 0, 1, "x", "x")], "batch_no long, ordinal int, op int, user_key string, value string")
    runs = spark.createDataFrame([(1, "running", t(3), t(3)), (1, "succeeded", t(3), t(4)), (2, "succeeded", t(7), t(8)), (2, "rolled_back", t(7), t(9)), (3, "running", t(9), t(9))], "run_id long, status string, read_upto timestamp, logged_at timestamp")
    pending = lambda runs, **k: incremental.process_pending(spark, scratch(spark, "work"), h, e, runs, **k).collect()
    assert sorted(r.seq for r in pending(runs)) == [12, 16]
    ops = {r.seq: (r.batch_no, r.op, r.user_key) for r in pending(runs, items=incremental.delivered_operations)}
    assert ops == {12: (2, 9, "b"), 16: (3, 1, "c")}
    none = runs.limit(0)
    assert sorted(r.seq for r in pending(none)) == [10, 11, 12, 16]
    ledger, now = incremental.replayed(spark, scratch(spark, "work"), runs)
    states = lambda now: {r.seq: r.state for r in incremental.item_states(incremental.delivered_items(h, e), ledger, now).collect()}
    assert states(now) == {10: "done", 11: "done", 12: "pending", 16: "pending"}
    ledger.lease("x", "2027-01-01 00:05:00", now, 10)
    assert states(now) == {10: "done", 11: "done", 12: "leased", 16: "pending"} and states(now + 11)[12] == "pending"


def test_work_ledger(spark, tmp_path):
    ledger = WorkLedger(spark, f"file://{tmp_path}/work")
    a = ledger.lease("a", "05", now=0, seconds=10)
    assert ledger.lease("b", "06", now=5, seconds=10) is None
    b = ledger.lease("b", "06", now=11, seconds=10)  # a's lease expired
    with pytest.raises(StaleLease):
        ledger.done(a, now=12)
    out = ledger.process(b, lambda after, upto: spark.createDataFrame([(after, upto)], "after string, upto string"), clock=lambda: 13)
    assert spark.read.parquet(out).collect()[0] == (None, "06")
    assert ledger.done_upto() == "06" and ledger.lease("a", "06", now=14, seconds=10) is None
    c = ledger.lease("c", "08", now=15, seconds=10)

    def fails(after, upto):
        raise ValueError("lost")

    with pytest.raises(ValueError):
        ledger.process(c, fails, clock=lambda: 16)
    d = ledger.lease("d", "08", now=17, seconds=10)  # released, so pending again
    assert d.after == "06" and d.folder.rpartition("/")[0] == c.folder.rpartition("/")[0]
    again = WorkLedger(spark, f"file://{tmp_path}/work")
    again.done(d, now=18)
    with pytest.raises(StaleLease):
        ledger.done(d, now=19)
    assert again.done_upto() == "08"


def rows_upto(spark):
    return lambda after, upto: spark.range(int(after or 0), int(upto)).select(F.col("id").alias("n"))


@pytest.mark.parametrize("crash", ["before the write", "after the write", "after done"])
def test_a_crash_neither_skips_nor_repeats(spark, tmp_path, crash):
    root = f"file://{tmp_path}/work"
    ledger = WorkLedger(spark, root)
    a = ledger.lease("a", "05", now=0, seconds=10)
    if crash != "before the write":
        rows_upto(spark)(None, "05").write.parquet(f"{root}/{a.folder}")
    if crash == "after done":
        ledger.done(a, 1, a.folder)
    ledger = WorkLedger(spark, root)
    b = ledger.lease("b", "08", now=11, seconds=10)
    ledger.process(b, rows_upto(spark), clock=lambda: 12)
    assert sorted(r.n for r in spark.read.parquet(*ledger.outputs()).collect()) == list(range(8))


def test_a_stale_writer_changes_no_output(spark, tmp_path):
    root = f"file://{tmp_path}/work"
    ledger = WorkLedger(spark, root)
    a = ledger.lease("a", "05", now=0, seconds=10)
    b = ledger.lease("b", "05", now=11, seconds=10)
    ledger.process(b, rows_upto(spark), clock=lambda: 12)
    with pytest.raises(StaleLease):  # a wakes up and writes after all
        ledger.process(a, lambda after, upto: spark.range(99).select(F.col("id").alias("n")), clock=lambda: 13)
    assert spark.read.parquet(*ledger.outputs()).count() == 5
    c = ledger.lease("c", "06", now=14, seconds=10)
    assert not (tmp_path / "work" / a.folder).exists() and (tmp_path / "work" / b.folder).exists()
    ledger.process(c, rows_upto(spark), clock=lambda: 15)
    assert sorted(r.n for r in spark.read.parquet(*ledger.outputs()).collect()) == list(range(6))


def test_a_torn_event_is_survived(spark, tmp_path):
    ledger = WorkLedger(spark, f"file://{tmp_path}/work")
    ledger.process(ledger.lease("a", "05", now=0, seconds=10), rows_upto(spark), clock=lambda: 1)
    for text in ("", '[{"ki'):
        (tmp_path / "work/log" / f"{ledger.events()[-1]['number'] + 1:012d}.json").write_text(text)
    assert ledger.done_upto() == "05" and len(ledger.outputs()) == 1
    ledger.process(ledger.lease("a", "07", now=2, seconds=10), rows_upto(spark), clock=lambda: 3)
    assert spark.read.parquet(*ledger.outputs()).count() == 7


def test_checkpoints_hold_the_whole_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(WorkLedger, "CHECKPOINT", 3)
    ledger = WorkLedger(spark, f"file://{tmp_path}/work")
    for i in range(1, 9):
        ledger.done(ledger.lease("a", f"{i:02d}", now=i, seconds=10), i, f"out/{i}")
        assert ledger.done_upto() == f"{i:02d}" and len(ledger.outputs()) == i
    assert len(ledger.events()) < 8


# --- small files


EDITS = "edit_no long, kind string, level int, file_number long, size long"


def test_live_and_small_files(spark):
    edits = [(1, "add", 0, 1, 100), (2, " ADD", 0, 2, 900_000), (3, "Delete", 0, 1, None), (3, "add", 1, 1, 200), (4, "add", 2, 3, None), (5, "add", 0, 4, 5), (9, "delete", 0, 4, None), (8, "add", 0, 4, 7), (6, "scalar", None, None, None), (7, "add", 0, 5, 524_288), (10, "add", 0, 6, 0), (10, "add", 0, 6, 0), (11, "add", None, 7, 3)]
    df = spark.createDataFrame(edits, EDITS)
    assert sorted((r.level if r.level is not None else -1, r.file_number, r.size) for r in smallfiles.live_files(df).collect()) == [(-1, 7, 3), (0, 2, 900_000), (0, 5, 524_288), (0, 6, 0), (1, 1, 200), (2, 3, None)]
    assert sorted((r.file_number, r.size) for r in smallfiles.small_files(df).collect()) == [(1, 200), (6, 0), (7, 3)]


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_consolidate(spark, tmp_path, broadcast_bytes):
    rows = [(i % 5, f"k{i % 7}", None if i % 3 else "v", i) for i in range(200)] + [(1, "k", None, 1)] * 3 + [(None, "x", "y", 0)]
    df = spark.createDataFrame(rows, "file_number long, user_key string, value string, _file long")
    edits = spark.createDataFrame([(1, "add", 0, 1, 10), (2, "add", 0, 3, 10), (3, "add", 0, 2, 10**7), (4, "add", 0, 99, 10)], EDITS)
    done = smallfiles.consolidate(df, edits, path=f"file://{tmp_path}/c", broadcast_bytes=broadcast_bytes)
    want = sorted((r for r in rows if r[0] in (1, 3)), key=repr)
    assert sorted((tuple(r) for r in done.rows(spark).collect()), key=repr) == want
    assert sorted(map(tuple, done.replaced(spark).collect())) == [(1, 10, 43), (3, 10, 40), (99, 10, 0)]
    again = smallfiles.consolidate(df.limit(0), edits, path=done.path)  # a repeated call finds the commit
    assert again == done and again.rows(spark).count() == 83
    change = done.edits(spark, edits)
    assert sorted(r.file_number for r in change.where("kind = 'delete'").collect()) == [1, 3, 99]
    adds = change.where("kind = 'add'").collect()
    assert adds and min(r.file_number for r in adds) > 99 and {r.name for r in adds} <= {n for n, _ in smallfiles.Files(spark, done.path).list(f"{done.attempt}/data")}


def test_the_first_commit_counts(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/c"
    edits = spark.createDataFrame([(1, "add", 0, 1, 10)], EDITS)
    rows = lambda n: spark.createDataFrame([(1, str(i)) for i in range(n)], "file_number long, v string")
    opened, real = [], smallfiles.Consolidation.open

    def late(spark, path):
        """The other attempt commits after this one has looked."""
        opened.append(1)
        if len(opened) == 1:
            smallfiles.consolidate(rows(3), edits, path=path)
            return None
        return real(spark, path)

    monkeypatch.setattr(smallfiles.Consolidation, "open", staticmethod(late))
    done = smallfiles.consolidate(rows(7), edits, path=path)
    assert done.rows(spark).count() == 3 and len(smallfiles.Files(spark, path).folders()) == 1


def test_a_difference_is_not_committed(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, "k")], "file_number long, user_key string")
    edits = spark.createDataFrame([(1, "add", 0, 1, 10)], EDITS)
    monkeypatch.setattr(smallfiles, "rebalanced_write", lambda rows, path, *a, **k: rows.union(rows).write.parquet(path))
    with pytest.raises(RuntimeError):
        smallfiles.consolidate(df, edits, path=f"file://{tmp_path}/c")
    assert smallfiles.Consolidation.open(spark, f"file://{tmp_path}/c") is None


def test_consolidate_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "file_number long, user_key string")
    done = smallfiles.consolidate(df, spark.createDataFrame([], EDITS), path=f"file://{tmp_path}/c")
    assert done.rows(spark).count() == 0 and done.replaced(spark).count() == 0


def test_checksum_tells_multisets_apart(spark):
    make = lambda rows: smallfiles.multiset_checksum(spark.createDataFrame(rows, "a string, b string"))
    assert make([("x", None), ("y", "z")]) == make([("y", "z"), ("x", None)])
    assert make([("x", None)]) != make([("x", "")]) and make([("x", "y")]) != make([("x", "y")] * 3)


def test_rebalance_reaches_target(spark, tmp_path):
    big = spark.range(400_000).select(F.sha2(F.col("id").cast("string"), 256).alias("v"))
    path = f"file://{tmp_path}/out"
    smallfiles.rebalanced_write(big.repartition(40), path, target_bytes=4 << 20, shuffled_per_stored=1.0)
    sizes = [s for n, s in smallfiles.Files(spark, path).list() if n.endswith(".parquet")]
    assert len(sizes) < 20 and max(sizes) < 8 << 20


# --- order, reads, versions, compaction, batches


def test_interval_sums_against_brute_force(spark):
    r = random.Random(5)
    iv = [(r.randrange(2), *sorted((r.choice("abcdefgh"), r.choice("abcdefgh"))), r.randrange(9)) for _ in range(60)] + [(0, None, "c", 5)]
    pts = [(r.randrange(3), *sorted((r.choice("abcdefgh"), r.choice("abcdefgh")))) for _ in range(30)] + [(0, None, "c"), (1, "d", None)]
    got = order.interval_sums(spark.createDataFrame(pts, "g int, lo string, hi string"), F.col("lo"), F.col("hi"), spark.createDataFrame(iv, "g int, lo_key string, hi_key string, w long"), {"s": F.col("w"), "n": F.lit(1).cast("long")}, group="g")
    want = []
    for g, lo, hi in pts:
        met = [w for h, a, b, w in iv if h == g and a is not None and (hi is None or a <= hi) and (lo is None or b >= lo)]
        want.append((g, lo, hi, sum(met), len(met)))
    assert sorted((tuple(x) for x in got.collect()), key=repr) == sorted(want, key=repr)


def test_positions_neighbours_and_islands_over_many_partitions(spark):
    r = random.Random(8)
    keys = r.sample(range(10_000), 500)
    df = spark.createDataFrame([(k, k + r.choice([0, 3, 40])) for k in keys], "lo int, hi int").repartition(7)
    got = {x.lo: x.position for x in order.positions(df, [F.desc("lo")]).collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(keys, reverse=True))}
    near = {x.lo: (x.prev_key, x.next_key) for x in order.neighbours(df.select("lo"), "lo").collect()}
    ks = sorted(keys)
    assert near == {k: (ks[i - 1] if i else None, ks[i + 1] if i + 1 < len(ks) else None) for i, k in enumerate(ks)}
    rows = sorted((x.lo, x.hi) for x in df.collect())
    want, reach, first = {}, -1, None
    for lo, hi in rows:
        if lo > reach:
            first = lo
        want[lo], reach = first, max(reach, hi)
    assert {x.lo: x.island for x in order.islands(df, "lo", "hi", [F.col("lo"), F.col("hi")]).collect()} == want
    assert order.islands(df.limit(0), "lo", "hi", [F.col("lo")]).count() == 0


def test_successor_and_prefix(spark):
    assert reads.successor(b"a\xff") == b"b" and reads.successor(b"\xff\xff") is None and reads.successor("ab") == b"ac"
    log = spark.createDataFrame([(bytearray(k), 1, 1, bytearray(b"v")) for k in (b"", b"a", b"a\xff", b"a\xff\x01", b"b", b"\xff")], "user_key binary, seq long, op int, value binary")
    assert sorted(bytes(r.user_key) for r in reads.prefix_scan(log, b"a\xff").collect()) == [b"a\xff", b"a\xff\x01"]
    assert reads.prefix_scan(log, b"\xff").count() == 1


@pytest.mark.parametrize("snapshot", [0, 30, 77, 1000])
def test_compaction_changes_no_visible_state(spark, snapshot):
    r = random.Random(snapshot)
    log = spark.createDataFrame([(r.choice("abcdeh") if i % 3 else "hot", i, r.randrange(2), str(i)) for i in range(1, 120)], "user_key string, seq long, op int, value string")
    kept = compaction.keep(log, snapshot)
    for s in {snapshot, 50 if snapshot <= 50 else snapshot, 500}:
        if s >= snapshot:
            assert sorted(map(tuple, reads.scan(log, s).collect())) == sorted(map(tuple, reads.scan(kept, s).collect()))
    deep = compaction.keep(log, snapshot, covered=log.select("user_key"))
    assert deep.count() >= kept.count()


READ_CORPUS = [(0, 60, "a", "d"), (0, 61, "c", "f"), (0, 62, "f", "f3"), (1, 59, "g", "j"), (1, 58, "o", "u"), (1, 57, "v", "y"), (2, 55, "k", "n"), (2, 54, "o", "s"), (2, 53, "v", "y"), (3, 52, "z1", "z7")]


def test_file_planning(spark):
    files = spark.createDataFrame([(lv, n, 20, lo, 1, hi, 1) for lv, n, lo, hi in READ_CORPUS], "level int, file_number long, size long, lo_key string, lo_seq long, hi_key string, hi_seq long")
    found = lambda df: sorted(r.file_number for r in df.collect())
    assert found(versions.files_for_key(files, "d")) == [60, 61]
    assert found(versions.files_for_key(files, "x")) == [53, 57]
    assert found(versions.files_for_key(files, "k")) == [55] and found(versions.files_for_key(files, "z")) == []
    for lo, hi in ((None, "a"), ("e", None), ("c", "e")):
        assert found(versions.grown_overlap(files, lo, hi)) == [60, 61, 62]
    assert versions.flush_level(files, "b", "e").first().level == 0
    assert versions.flush_level(files, "l", "n", max_file_size=20).first().level == 1
    assert versions.flush_level(files, "z1", "z7", max_file_size=1).first().level == 1
    from tidemark.operators.merge import run_count

    assert run_count(files).first().n_runs == 6


def test_group_commit(spark):
    q = lambda rows: sorted(r.batch_no for r in writes.group_commit(spark.createDataFrame(rows, "batch_no long, size long, synchronous boolean")).collect())
    assert q([(1, 10, False), (2, 10, False), (3, 10, True), (4, 10, False)]) == [1, 2]
    assert q([(1, 10, True), (2, 10, True), (3, 10, False)]) == [1, 2, 3]
    assert q([(1, 10, False), (2, 131_072, False), (3, 1, False)]) == [1, 2]
    assert q([(1, 2_000_000, False), (2, 1, False)]) == [1]
    assert q([]) == []


def test_assign_sequence(spark):
    df = spark.range(1000).select((999 - F.col("id")).alias("n"))
    got = writes.assign_sequence(df, [F.col("n")], 5).collect()
    assert sorted((r.n, r.seq) for r in got) == [(i, i + 6) for i in range(1000)]


def test_scratch_is_cleaned(spark):
    from tidemark import storage

    before = list(storage._made)
    storage._made.clear()
    df = storage.written(spark.range(3).toDF("id"), "cleaning")
    assert df.count() == 3
    folder = storage._made[0]
    assert storage.clean(spark) == 1 and not storage.Files(spark, folder).exists()
    storage._made.extend(before)
