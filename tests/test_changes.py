import random

import pytest

from tidemark.operators.changes import current_state

SCHEMA = "user_key string, seq long, op int, value string, note string, _chunk int, value2 string"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def frame(spark, data):
    return spark.createDataFrame([(k, s, o, v, "n", 1, "w") for k, s, o, v in data], SCHEMA)


def brute(data, base=(), update=None):
    state = {k: (s, v) for k, s, v in base}
    deleted = {}
    ops = sorted({(s, o, k, v) for k, s, o, v in data if k is not None and s is not None and o in (0, 1, update)}, key=lambda x: (x[0], x[1] if x[1] != update else 9, x[3] or ""))
    for s, o, k, v in ops:
        seen = max(state.get(k, (-1,))[0], deleted.get(k, -1))
        if o == 1 and s >= seen:
            state[k] = (s, v)
        elif o == 0 and s >= seen:
            state.pop(k, None)
            deleted[k] = s
        elif o == update and k in state and v is not None and s > state[k][0]:
            state[k] = (state[k][0], v)
    return sorted(((k, *x) for k, x in state.items()), key=repr)


def test_repeated_and_out_of_order(spark):
    data = [("a", 3, 0, None), ("a", 1, 1, "x"), ("a", 1, 1, "x"), ("b", 9, 1, ""), ("b", 2, 0, "late"), ("", 5, 1, None), ("A", 1, 1, "other")]
    assert rows(current_state(frame(spark, data)), "user_key", "seq", "value") == brute(data) == [("", 5, None), ("A", 1, "other"), ("b", 9, "")]


def test_damaged_rows_are_no_changes(spark):
    data = [(None, 1, 1, "x"), ("a", None, 1, "x"), ("a", 2, None, "x"), ("a", 3, 7, "x"), ("a", 1, 1, "ok")]
    assert rows(current_state(frame(spark, data)), "user_key", "seq", "value") == [("a", 1, "ok")]


def test_ties(spark):
    data = [("a", 1, 0, None), ("a", 1, 1, "b"), ("a", 1, 1, "c"), ("a", 1, 1, None)]
    assert rows(current_state(frame(spark, data)), "user_key", "seq", "value") == [("a", 1, "c")]


def test_empty(spark):
    assert current_state(frame(spark, [])).count() == 0
    base = spark.createDataFrame([("a", 1, "v")], "user_key string, seq long, value string")
    assert rows(current_state(frame(spark, []), base=base), "user_key", "seq", "value") == [("a", 1, "v")]


def test_long_values(spark):
    data = [("k" * 100_000, 1, 1, "v" * 1_000_000)]
    assert len(current_state(frame(spark, data)).first().value) == 1_000_000


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("update", [None, 2])
def test_random_against_replay(spark, seed, update):
    r = random.Random(seed)
    keys = ["hot"] * 8 + list("abcd")
    ops = {}
    for s in range(20, 220):
        ops[s] = (r.choice(keys), s, r.choice([0, 1, 1, 2]), r.choice(["", "x", "y", None, str(s)]))
    data = list(ops.values()) + r.choices(list(ops.values()), k=60)
    r.shuffle(data)
    base = [("hot", 5, "base"), ("z", 6, "zz"), ("a", 300, "newer")]
    b = spark.createDataFrame(base, "user_key string, seq long, value string")
    got = current_state(frame(spark, data).repartition(3), base=b, update=update, range_bits=4)
    assert rows(got, "user_key", "seq", "value") == brute(data, base, update)


def test_updates_of_single_columns(spark):
    data = [("a", 1, 1, "p", "q"), ("a", 2, 2, None, "Q"), ("a", 3, 2, "P", None), ("b", 1, 2, "lost", "lost")]
    df = spark.createDataFrame(data, "user_key string, seq long, op int, v string, w string")
    got = current_state(df, values=("v", "w"), update=2)
    assert rows(got, "user_key", "seq", "v", "w") == [("a", 1, "P", "Q")]
