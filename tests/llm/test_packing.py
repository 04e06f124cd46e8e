import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import packing, tokens

SIZED = "row long, doc_id long, source string, n_tokens long"


def sized(spark, rows):
    return spark.createDataFrame([(i, i, s, n) for i, (s, n) in enumerate(rows)], SIZED)


def check(places, rows, capacity):
    """Every item is placed once and whole, no container overflows, only long items are cut."""
    by_doc, by_container = {}, {}
    for p in places:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_container.setdefault(p.container, []).append(p)
    for i, (_, n) in enumerate(rows):
        pieces = sorted(by_doc.pop(i, []), key=lambda p: p.piece)
        assert sum(p.n_tokens for p in pieces) == (n or 0)
        assert len(pieces) == -(-(n or 0) // capacity)
        assert [p.start_token for p in pieces] == [capacity * k for k in range(len(pieces))]
    assert not by_doc
    assert all(sum(p.n_tokens for p in c) <= capacity for c in by_container.values())
    return by_container


@pytest.mark.parametrize("shard", [10**9, 5000])
def test_packing_is_whole_and_tight(spark, shard):
    r = random.Random(0)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.choice([r.randrange(1, 60), r.randrange(1, 300), 100, 250, 0, None])) for _ in range(1500)]
    places = packing.pack(sized(spark, rows), capacity=100, shard_tokens=shard).collect()
    containers = check(places, rows, 100)
    total = sum(n or 0 for _, n in rows)
    assert len(containers) <= 1.01 * -(-total // 100) + -(-total // shard)


def test_containers_are_mixed(spark):
    r = random.Random(1)
    rows = [("a", r.randrange(1, 20)) for _ in range(3000)] + [("b", r.randrange(1, 20)) for _ in range(1000)]
    places = packing.pack(sized(spark, rows), capacity=400, shard_tokens=8000).collect()
    containers = check(places, rows, 400)
    share = sum(n for s, n in rows if s == "b") / sum(n for _, n in rows)
    off = [abs(sum(p.n_tokens for p in c if p.source == "b") / sum(p.n_tokens for p in c) - share) for c in containers.values() if sum(p.n_tokens for p in c) > 380]
    assert sum(off) / len(off) < 0.05


def test_accounts_are_carried_over():
    owed = {"a": 300.0, "b": -300.0}
    items = [("a", 10, i) for i in range(60)] + [("b", 10, 100 + i) for i in range(60)]
    first, account = next(packing.pack_shard(items, None, owed, 100))
    assert all(s == "a" for s, _, _ in first) and account == {"a": 250.0, "b": -250.0}


def test_sources_are_dealt_evenly_to_shards(spark):
    r = random.Random(4)
    rows = [("a", r.randrange(1, 90)) for _ in range(4000)] + [("b", r.randrange(1, 90)) for _ in range(400)] + [("c", 5)] * 7
    places = packing.pack(sized(spark, rows), capacity=100, shard_tokens=20_000).collect()
    check(places, rows, 100)
    per = {}
    for p in places:
        per.setdefault(p.container >> 32, {}).setdefault(p.source, []).append(p.n_tokens)
    assert len(per) > 8
    whole = sum(n for _, n in rows)
    for source in "ab":
        share = sum(n for s, n in rows if s == source) / whole
        assert all(abs(sum(h.get(source, [])) / sum(map(sum, h.values())) - share) < 0.03 for h in per.values())


def test_the_last_containers_are_mixed_like_the_first():
    r = random.Random(5)
    items = [(s, min(400, int(r.expovariate(1 / 60)) + 1), i) for i, s in enumerate(r.choices(["a", "b", "c"], [6, 3, 1], k=6000))]
    whole = sum(n for _, n, _ in items)
    target = {s: sum(n for t, n, _ in items if t == s) / whole for s in "abc"}
    off = []
    for container, _ in packing.pack_shard(items, None, {}, 2048):
        size = sum(n for _, n, _ in container)
        off.append(sum(abs(sum(n for t, n, _ in container if t == s) / size - target[s]) for s in target) / 2)
    tenth = len(off) // 10
    assert len(off) == -(-whole // 2048) and sum(off) / len(off) < 0.1 and sum(off[-tenth:]) / tenth < 0.15


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(1, 40)), max_size=60), st.booleans())
def test_no_container_is_overfull(rows, shares):
    items = [(s, n, i) for i, (s, n) in enumerate(rows)]
    out = [c for c, _ in packing.pack_shard(items, {"a": 0.7, "b": 0.3} if shares else None, {}, 40)]
    assert sorted(x for c in out for x in c) == sorted(items) and all(c and sum(n for _, n, _ in c) <= 40 for c in out)


def test_repeated_long_rows_have_containers_of_their_own(spark):
    df = spark.createDataFrame([(7, 7, "a", 5000)] * 3, SIZED)
    places = packing.pack(df)
    assert packing.overfull(places).count() == 0 and packing.containers(places).where("fill = 1").count() == 6
    assert packing.mixture(places).agg(F.sum("target_tokens")).first()[0] == 15000
    assert all(r.off_target == 0 for r in packing.containers(places).collect())


def test_sums_before(spark, monkeypatch):
    monkeypatch.setattr(packing, "SUM_BLOCK", 4)
    rows = [(g, i, (i * 7) % 5) for g in "xy" for i in range(0, 23, 1 if g == "x" else 3)]
    got = packing.sums_before(spark.createDataFrame(rows, "g string, i long, v long"), ["g"], "i", "v", "b").collect()
    assert {(r.g, r.i): r.b for r in got} == {(g, i): sum(v for h, j, v in rows if h == g and j < i) for g, i, _ in rows}


def test_edges(spark):
    empty = sized(spark, [])
    assert packing.pack(empty).count() == 0 and packing.cut_documents(packing.pack(empty)).count() == 0
    rows = [("a", 2048), ("a", 2049), ("b", 4096), (None, None), ("a", 0), ("a", 1)]
    places = packing.pack(sized(spark, rows))
    check(places.collect(), rows, 2048)
    assert sorted(r.doc_id for r in packing.cut_documents(places).collect()) == [1, 2]
    got = {r.n_tokens: (r.n_items, r.room_left) for r in packing.containers(places).collect()}
    assert got[2048][1] == 0 and got[2] == (2, 2046)


def test_repeated_rows_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "hello world", "A  b", 7)] * 3 + [(None, None, None, 7), (2, "", "a_B", 7)], "doc_id long, text string, source string, row int")
    s = tokens.sized(docs)
    assert sorted((r.doc_id or 0, r.source, r.n_tokens) for r in s.collect()) == [(0, None, 0), (1, "a-b", 2), (1, "a-b", 2), (1, "a-b", 2), (2, "a-b", 0)]
    assert packing.pack(s).agg(F.sum("n_tokens")).first()[0] == 6


def test_token_counts_are_those_of_the_tokenizer(spark):
    texts = ["", "a", "Ünïcödé 🙂🙂", "x" * 20_000, "<|endoftext|>", "  \n\n a"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    got = [r[0] for r in df.select(tokens.token_count("text")).collect()]
    assert got == [len(tokens.encoding().encode_ordinary(t)) for t in texts] + [None]
