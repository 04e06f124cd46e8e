import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tidemark.functions import bloom
from tidemark.functions import bytes as b
from tidemark.schema import NEWEST
from tidemark.sources import connectors, formats


def test_separators():
    assert b.separator(b"shoal", b"shoals") == b"shoal"
    assert b.separator(b"kelp", b"marl") == b"l" and b.separator(b"reef", b"ebb") == b"reef"
    assert b.key_successor(b"marl") == b"n" and b.key_successor(b"\xff\xffm") == b"\xff\xffn" and b.key_successor(b"\xff") == b"\xff"
    assert b.internal_separator((b"kelp", 3, 1), (b"marl", 1, 1)) == (b"l", NEWEST, 1)
    assert b.internal_successor((b"kelp", 3, 1)) == (b"l", NEWEST, 1)


@given(st.binary(max_size=6), st.binary(max_size=6))
def test_separator_lies_between(x, y):
    lo, hi = sorted((x, y))
    s = b.separator(lo, hi)
    assert lo <= s and (s < hi or lo == hi)
    assert b.key_successor(lo) >= lo


def test_checksums():
    assert b.crc32c(b"123456789") == 0xE3069283
    rows = [b"", b"123456789", b"a" * 1000, b"\x00"]
    assert b.crc32c_all(rows).tolist() == [b.crc32c(r) for r in rows]
    for r in rows:
        assert b.unmask(b.mask(b.crc32c(r))) == b.crc32c(r) != b.mask(b.crc32c(r))


def test_bloom_vectors():
    assert [int(x) for x in bloom.hashes([b"", b"\x62", b"\xc3\x97", b"\xe2\x99\xa5", b"\xe1\x80\xb9\x32"])] == [0xBC9F1D34, 0xEF1345C4, 0x5B663814, 0x323C078F, 0xED21633A]
    f = bloom.build([b"ebb", b"flow"])
    assert bloom.may_match([b"ebb", b"flow", b"shingle", b"groyne"], [f] * 4).tolist() == [True, True, False, False]


@pytest.mark.parametrize("n", [1, 100, 5000])
def test_bloom_rate(n):
    keys = [struct.pack("<I", i) for i in range(n)]
    f = bloom.build(keys)
    assert bloom.may_match(keys, [f] * n).all()
    others = [struct.pack("<I", 1_000_000_000 + i) for i in range(10_000)]
    assert bloom.may_match(others, [f] * len(others)).mean() <= 0.02


@given(st.lists(st.binary(max_size=80), max_size=8))
def test_log_round_trip(records):
    assert list(formats.decode_log(formats.encode_log(records))) == records


def test_log_fragments_and_damage():
    big = [b"small", b"x" * 50_000, b"", b"y" * 100_000, b"z" * (32768 - 14), b"", b"end"]
    data = formats.encode_log(big)
    assert list(formats.decode_log(data)) == big
    assert list(formats.decode_log(data[:-2])) == big[:-1]  # torn end
    hurt = bytearray(data)
    hurt[9] ^= 1
    assert list(formats.decode_log(bytes(hurt))) == big[1:]
    assert formats.encode_log(big[:2]) + formats.encode_log(big[2:], len(formats.encode_log(big[:2]))) == data


@given(st.lists(st.tuples(st.sampled_from([0, 1]), st.binary(max_size=9), st.binary(max_size=9)), max_size=6))
def test_batch_round_trip(ops):
    ops = [(o, k, v if o else None) for o, k, v in ops]
    assert formats.decode_batch(formats.encode_batch(43, ops)) == (43, ops)


@settings(max_examples=30)
@given(st.dictionaries(st.tuples(st.binary(max_size=5), st.integers(1, 50)), st.tuples(st.sampled_from([0, 1]), st.binary(max_size=60)), max_size=60))
def test_table_round_trip(entries):
    rows = [(k, s, o, v if o else None) for (k, s), (o, v) in sorted(entries.items(), key=lambda e: (e[0][0], -e[0][1]))]
    t = formats.Table(formats.encode_table(rows, block_bytes=100))
    assert list(t.entries()) == rows
    for k, s, o, v in rows:
        assert t.get(k, s) == (s, o, v)


def test_table_reads():
    rows = [(b"ebb", 1, 1, b"1"), (b"kelp", 3, 1, b"3"), (b"kelp", 2, 0, None), (b"marl", 5, 0, None), (b"marl", 4, 1, b"4"), (b"marl", 1, 1, b"1")]
    data = formats.encode_table(rows)
    t = formats.Table(data)
    assert t.get(b"kelp", 3)[2] == t.get(b"kelp", 20)[2] == b"3"
    assert t.get(b"kelp", 2) == (2, 0, None) and t.get(b"kelp", 1) is None and t.get(b"zz", 9) is None
    assert [e[:2] for e in t.scan(b"kelp")] == [(b"kelp", 3), (b"kelp", 2), (b"marl", 5), (b"marl", 4), (b"marl", 1)]
    assert [e[:2] for e in t.scan(b"l", reverse=True)] == [(b"kelp", 2), (b"kelp", 3), (b"ebb", 1)]
    with pytest.raises(ValueError):
        formats.encode_table(rows[::-1])
    hurt = bytearray(data)
    hurt[3] ^= 1
    with pytest.raises(ValueError):
        list(formats.Table(bytes(hurt)).entries())
    with pytest.raises(ValueError):
        formats.Table(b"x" * 60)


@settings(max_examples=40)
@given(st.dictionaries(st.tuples(st.binary(max_size=3), st.integers(1, 9)), st.binary(max_size=9), max_size=80), st.binary(max_size=3))
def test_table_scans_begin_anywhere(entries, key):
    rows = [(k, s, 1, v) for (k, s), v in sorted(entries.items(), key=lambda e: (e[0][0], -e[0][1]))]
    t = formats.Table(formats.encode_table(rows, block_bytes=64))
    assert list(t.scan(key)) == [r for r in rows if r[0] >= key] and list(t.scan(key, reverse=True)) == [r for r in rows[::-1] if r[0] < key]
    assert list(t.scan(reverse=True)) == rows[::-1]


@given(st.lists(st.binary(max_size=4), min_size=1, max_size=70, unique=True), st.binary(max_size=4))
def test_block_seek(keys, target):
    entries = [(k, b"v" + k) for k in sorted(keys)]
    assert formats.seek_block(formats.encode_block(entries, restart=3), target, lambda k: k) == [e for e in entries if e[0] >= target]


def test_filters_are_known_by_name():
    rows = [(b"k%03d" % i, 1, 1, b"v") for i in range(300)]
    mine = formats.Table(formats.encode_table(rows, filter_name="filter.other.BloomFilter"))
    assert mine.filters is None and mine.get(b"k007", 9) == (1, 1, b"v")  # nobody knows that filter
    formats.register_filter("filter.other.BloomFilter", formats.FilterPolicy(bloom.build, lambda k, f: bool(bloom.may_match([k], [f])[0])))
    try:
        t = formats.Table(formats.encode_table(rows, filter_name="filter.other.BloomFilter"))
        assert t.filters and t.get(b"k007", 9) == (1, 1, b"v") and t.get(b"k0075", 9) is None
    finally:
        del formats.FILTERS["filter.other.BloomFilter"]


def test_filter_block():
    data = formats.encode_filter_block([(0, [b"a"]), (100, [b"b"]), (5000, [b"c"])])
    filters, bits = formats.decode_filter_block(data)
    ask = lambda at, k: formats.filter_may_match(filters, bits, at, k)
    assert ask(0, b"a") and ask(100, b"b") and ask(5000, b"c") and not ask(0, b"c") and not ask(2100, b"a") and ask(99999, b"a")
    assert formats.decode_filter_block(formats.encode_filter_block([])) == ([], 11)


def test_edit_round_trip():
    e = formats.Edit(1, None, 3, 4, [(2, (b"k", 9, 1))], [(0, 7)], [(6, 8, 100, (b"", 5, 1), (b"z", 1, 0))])
    assert formats.decode_edit(formats.encode_edit(e)) == e
    with pytest.raises(ValueError):
        formats.decode_edit(b.varint(1) + b.varint(0))
    with pytest.raises(ValueError):
        formats.decode_edit(b.varint(6) + b.varint(7) + b.varint(1))


def test_snappy_frames():
    data = bytes(range(256)) * 600
    assert formats.unsnappy_frames(formats.snappy_frames(data)) == data


def test_columns_against_scalars(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(bytearray(b"abc"), bytearray(b"abz")), (bytearray(b""), None), (None, bytearray(b"x"))], "a binary, c binary")
    got = df.select(b.separator_of(F.col("a"), F.col("c")).alias("s"), b.successor_of(F.col("a")).alias("t"), b.crc32c_of(F.col("a")).alias("crc"), b.masked(b.crc32c_of(F.col("a"))).alias("m"), bloom.bloom_hash(F.col("a")).alias("h")).collect()
    assert (bytes(got[0].s), bytes(got[0].t), got[0].crc, got[0].m) == (b"abd", b"b", b.crc32c(b"abc"), b.mask(b.crc32c(b"abc")))
    assert got[1].s is None and bytes(got[1].t) == b"" and got[2].crc is None and got[2].h is None
    names = spark.createDataFrame([("data/000012.rdb",), ("wal-7.log",), ("MANIFEST-3.manifest",), ("CURRENT",), (None,)], "n string")
    assert [r[0] for r in names.select(b.file_number(F.col("n"))).collect()] == [12, 7, 3, None, None]


def test_a_key_is_split_over_table_files(spark, tmp_path):
    df = spark.range(4000).select(F.lit("hot").cast("binary").alias("user_key"), F.col("id").alias("seq"), F.lit(1).alias("op"), F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("value"))
    files = connectors.write_tables(df, f"file://{tmp_path}/t", file_bytes=20_000, partitions=4).collect()
    assert len(files) > 8 and max(r.n_entries for r in files) < 400
    back = connectors.read_tables(spark, f"file://{tmp_path}/t")
    assert back.count() == 4000 == back.select("seq").distinct().count()


def test_tables_are_asked_for_many_keys(spark, tmp_path):
    rows = [(bytearray(b"k%02d" % (i % 40)), i, 0 if i % 3 == 0 else 1, bytearray(b"%d" % i)) for i in range(400)]
    df = spark.createDataFrame(rows, "user_key binary, seq long, op int, value binary")
    connectors.write_tables(df, f"file://{tmp_path}/t", file_bytes=900, partitions=3).collect()
    keys = spark.createDataFrame([(bytearray(b"k%02d" % i),) for i in range(0, 60, 7)] * 2 + [(None,)], "key binary")
    got = {bytes(r.key): (r.seq, r.op, r.value and bytes(r.value)) for r in connectors.lookup_tables(spark, f"file://{tmp_path}/t", keys, 350).collect()}
    want = {}
    for k, s, o, v in rows:
        if s <= 350 and int(bytes(k)[1:]) % 7 == 0 and s > want.get(bytes(k), (-1,))[0]:
            want[bytes(k)] = (s, o, bytes(v) if o else None)
    assert got == want


def test_connectors_with_nulls_and_no_files(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert connectors.read_logs(spark, f"file://{tmp_path}/none").count() == 0
    rows = [(bytearray(b""), 1, 1, bytearray(b"")), (bytearray(b"k" * 70_000), 2, 0, None), (bytearray(b"a"), 9, 1, bytearray(b"v" * 200_000))]
    df = spark.createDataFrame(rows, "user_key binary, seq long, op int, value binary")
    connectors.write_logs(df, f"file://{tmp_path}/w", files=2).collect()
    connectors.write_tables(df, f"file://{tmp_path}/t").collect()
    plain = lambda d: sorted((bytes(r.user_key), r.seq, r.op, None if r.value is None else bytes(r.value)) for r in d.collect())
    want = sorted((bytes(k), s, o, None if v is None else bytes(v)) for k, s, o, v in rows)
    assert plain(connectors.read_logs(spark, f"file://{tmp_path}/w")) == want == plain(connectors.read_tables(spark, f"file://{tmp_path}/t"))
