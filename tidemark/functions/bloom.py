"""The project's Bloom filter: hash, building, membership, and its measured rate of wrong answers.

A filter is one byte with the number of probes, then the bits, least significant bit of each byte
first. Probes are ``h + i * rotate_right(h, 17)`` modulo the number of bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the filter format.
HASH_SEED = 0xBC9F1D34
HASH_MULTIPLIER = 0xC6A4A793
FILTER_RANGE_BYTES = 2048
#: Keys and filters that are asked of each other at once; an array of so many words stays in a core's cache.
KEY_BLOCK, FILTER_BLOCK = 2**14, 2**12


def hashes(keys: Iterable[bytes]) -> np.ndarray:
    """32-bit hash of each key, computed for all keys a word at a time."""
    keys = list(keys)
    lengths = np.array([len(k) for k in keys], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    longest_first = lengths[order]
    h = (np.uint32(HASH_SEED) ^ (longest_first.astype(np.uint64) * HASH_MULTIPLIER).astype(np.uint32)).astype(np.uint32)
    data = np.frombuffer(b"".join(keys) + b"\0\0\0\0", dtype=np.uint8)
    start = np.concatenate([[0], np.cumsum(lengths)])[:-1][order] if len(keys) else np.zeros(0, dtype=np.int64)
    words = longest_first // 4
    with np.errstate(over="ignore"):
        for w in range(int(words[0]) if len(keys) else 0):
            n = int(np.searchsorted(-words, -w, side="left"))  # rows with more than w words
            at = start[:n] + 4 * w
            word = data[at].astype(np.uint32) | data[at + 1].astype(np.uint32) << 8 | data[at + 2].astype(np.uint32) << 16 | data[at + 3].astype(np.uint32) << 24
            x = (h[:n] + word) * np.uint32(HASH_MULTIPLIER)
            h[:n] = x ^ (x >> np.uint32(16))
        rest, at = longest_first % 4, start + 4 * words
        tail = np.zeros(len(keys), dtype=np.uint32)
        for i in range(3):
            has = rest > i
            tail[has] += data[at[has] + i].astype(np.uint32) << np.uint32(8 * i)
        has = rest > 0
        x = (h[has] + tail[has]) * np.uint32(HASH_MULTIPLIER)
        h[has] = x ^ (x >> np.uint32(24))
    out = np.empty_like(h)
    out[order] = h
    return out


def _probes(h: np.ndarray, k: int) -> np.ndarray:
    delta = (h >> np.uint32(17)) | (h << np.uint32(15))
    with np.errstate(over="ignore"):
        return h[:, None] + delta[:, None] * np.arange(k, dtype=np.uint32)[None, :]


def build(keys: Iterable[bytes], bits_per_key: int = 10, n_keys: int | None = None) -> bytes:
    """A filter over the keys; never denies one of them. ``n_keys``: number it is sized for, when keys recur."""
    keys = list(keys)
    k = min(30, max(1, int(bits_per_key * 0.69)))
    n_bytes = (max(64, (n_keys or len(keys)) * bits_per_key) + 7) // 8
    bits = np.zeros(n_bytes * 8, dtype=np.uint8)
    if keys:
        bits[_probes(hashes(keys), k).ravel() % np.uint32(n_bytes * 8)] = 1
    return bytes([k]) + np.packbits(bits, bitorder="little").tobytes()


def may_match(keys: list[bytes], filters: list[bytes | None]) -> np.ndarray:
    """Whether each key may be in the filter beside it. A filter without bits, or none at all, denies no key."""
    out = np.ones(len(keys), dtype=bool)
    usable = [i for i, f in enumerate(filters) if f is not None and len(f) >= 2]
    if not usable:
        return out
    h = hashes([keys[i] for i in usable])
    bits = np.array([len(filters[i]) * 8 - 8 for i in usable], dtype=np.uint32)
    offset = np.concatenate([[0], np.cumsum([len(filters[i]) for i in usable])])[:-1]
    data = np.frombuffer(b"".join(filters[i] for i in usable), dtype=np.uint8)
    k = data[offset]
    probes = _probes(h, int(k.max())) % bits[:, None]
    hit = (data[offset[:, None] + 1 + probes // 8] >> (probes % 8).astype(np.uint8)) & 1
    needed = np.arange(int(k.max()))[None, :] < k[:, None]
    out[usable] = ((hit == 1) | ~needed).all(axis=1)
    return out


def all_matches(h: np.ndarray, filters: Iterable[bytes]) -> Iterator[np.ndarray]:
    """For each filter, in any order, whether it may hold the key of each hash.

    A key is a mask of the bits that it needs, made once for all filters of one size and number of probes.
    """
    alike: dict[tuple[int, int], list[bytes]] = {}
    for f in filters:
        alike.setdefault((f[0], len(f) - 1) if len(f) >= 2 else (0, 0), []).append(f)
    for (k, n_bytes), group in alike.items():
        n_words = max(1, -(-n_bytes // 8))
        masks = np.zeros((n_words, len(h)), dtype=np.uint64)
        if k:
            for bit in (_probes(h, k) % np.uint32(n_bytes * 8)).T:
                masks[bit >> np.uint32(6), np.arange(len(h))] |= np.uint64(1) << (bit & np.uint32(63)).astype(np.uint64)
        for f in group:
            lacks = ~np.frombuffer(f[1:].ljust(n_words * 8, b"\0"), dtype="<u8")[:n_words]
            bad = masks[0] & lacks[0]
            for w in range(1, n_words):
                bad |= masks[w] & lacks[w]
            yield bad == 0


@F.pandas_udf(T.LongType())
def bloom_hash(key: pd.Series) -> pd.Series:
    """Hash of binary keys as an unsigned number; null for null."""
    known = key.notna()
    out = pd.Series([None] * len(key), dtype="Int64")
    if known.any():
        out[known.to_numpy()] = hashes(bytes(k) for k in key[known]).astype(np.int64)
    return out


@F.pandas_udf(T.BooleanType())
def key_may_match(key: pd.Series, filter: pd.Series) -> pd.Series:
    """Membership test of binary keys in serialized filters; null for a null key, true for a lost filter."""
    known = key.notna()
    out = pd.Series([None] * len(key), dtype="boolean")
    if known.any():
        out[known.to_numpy()] = may_match([bytes(k) for k in key[known]], [None if f is None else bytes(f) for f in filter[known]])
    return out


def build_filters(keys: DataFrame, by: list[str], key: str, bits_per_key: int = 10, n_keys: str | None = None) -> DataFrame:
    """One filter for each group of binary keys: the keys of a block, so groups are as small as blocks are.

    ``n_keys`` names a column of ``by`` with the number of keys that the filter is sized for.
    """

    def build_one(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in part:
            yield pd.DataFrame({**{b: pdf[b] for b in by}, "filter": [build([bytes(k) for k in ks], bits_per_key, n) for ks, n in zip(pdf["_keys"], pdf[n_keys] if n_keys else [None] * len(pdf))]})

    grouped = keys.where(F.col(key).isNotNull()).groupBy(*by).agg(F.collect_list(key).alias("_keys"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.select(*by).schema) + ", filter binary"
    return grouped.mapInPandas(build_one, schema)


def _ask_all(keys: DataFrame, filters: DataFrame) -> DataFrame:
    """Every key (``key``, ``inside``: in some block) against every filter, in blocks of both.

    One row: the pairs answered yes, ``yes``; the keys outside, ``n_outside``, those of them to which some
    filter says yes, ``outside_yes``; and the keys inside to which none does, ``inside_no``.
    """
    n_k, n_f = (max(1, -(-x.count() // size)) for x, size in ((keys, KEY_BLOCK), (filters, FILTER_BLOCK)))
    hashed = keys.select(F.pmod(F.xxhash64("key"), F.lit(n_k)).alias("k"), bloom_hash(F.col("key").cast("binary")).alias("h"), "inside")
    k = hashed.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("h", "inside"))).alias("_keys")).select("k", F.col("_keys.h").alias("h"), F.col("_keys.inside").alias("inside"))
    f = filters.groupBy(F.pmod(F.xxhash64("file_number", "filter_index"), F.lit(n_f)).alias("f")).agg(F.collect_list("filter").alias("filters"))

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for no, h, inside, fs in zip(pdf["k"], pdf["h"], pdf["inside"], pdf["filters"]):
                said, yes = np.zeros(len(h), dtype=bool), 0
                for match in all_matches(np.asarray(h).astype(np.uint32), [bytes(x) for x in fs]):
                    yes += int(np.count_nonzero(match))
                    said |= match
                yield pd.DataFrame({"k": [no], "yes": [yes], "said": [np.packbits(said).tobytes()], "inside": [np.packbits(np.asarray(inside, dtype=bool)).tobytes()], "n": [len(h)]})

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        bits = lambda x: np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=n).astype(bool)
        said, inside = np.zeros(n, dtype=bool), bits(pdf["inside"].iloc[0])
        for x in pdf["said"]:
            said |= bits(x)
        return pd.DataFrame({"yes": [int(pdf["yes"].sum())], "n_outside": [int((~inside).sum())], "outside_yes": [int((~inside & said).sum())], "inside_no": [int((inside & ~said).sum())]})

    asked = k.crossJoin(f).repartition(max(1, n_k * n_f // 4), "k", "f")
    answers = asked.select("k", "h", "inside", "filters").mapInPandas(ask, "k long, yes long, said binary, inside binary, n long")
    sums = answers.groupBy("k").applyInPandas(some, "yes long, n_outside long, outside_yes long, inside_no long")
    return sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums.columns])


def _own_pairs(filter_keys: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each key with the filter of the block that holds it."""
    own = filter_keys.where(F.col("user_key").isNotNull()).select(
        F.col("user_key").alias("key"), F.col("file_number").alias("f"), F.expr("block_offset div " + str(FILTER_RANGE_BYTES)).alias("i")
    ).distinct()
    return own.join(blocks, (F.col("f") == F.col("file_number")) & (F.col("i") == F.col("filter_index")))


def _stored_filters(filter_blocks: DataFrame) -> DataFrame:
    return filter_blocks.where(F.col("filter").isNotNull()).select("file_number", "filter_index", "filter").distinct()


def _with_rate(report: DataFrame) -> DataFrame:
    return report.withColumn("rate", (F.col("wrong_yes") + F.col("wrong_no")) / F.greatest(F.col("asked"), F.lit(1)))


def own_key_errors(filter_keys: DataFrame, filter_blocks: DataFrame) -> DataFrame:
    """``filters, own keys``: every key against the filter of its own block; a no is wrong. Lost filters deny nothing."""
    pairs = _own_pairs(filter_keys, _stored_filters(filter_blocks))
    said = pairs.select(key_may_match(F.col("key").cast("binary"), F.col("filter")).alias("yes"))
    return _with_rate(said.agg(F.lit("filters, own keys").alias("answered_by"), F.count(F.lit(1)).alias("asked"), F.lit(0).cast("long").alias("wrong_yes"), F.count_if(~F.col("yes")).alias("wrong_no")))


def ledger_errors(filter_keys: DataFrame, probes: DataFrame) -> DataFrame:
    """``ledger``: the exact ledger, held against a plain join over all probes."""
    from tidemark.operators.seen import seen_before

    ledger = seen_before(probes, filter_keys).select(F.col("probe_id").alias("_yes")).distinct()
    p = probes.where(F.col("user_key").isNotNull() & F.col("probe_id").isNotNull()).select("probe_id", "user_key").distinct()
    first = p.groupBy(F.col("user_key").alias("_k")).agg(F.min("probe_id").alias("_first"))
    past = filter_keys.where(F.col("user_key").isNotNull()).select(F.col("user_key").alias("_k")).distinct().withColumn("_past", F.lit(True))
    fresh = first.join(past, "_k", "left").where(F.col("_past").isNull()).select(F.col("_first").alias("_fresh"), "_k")
    truth = p.join(fresh, (F.col("probe_id") == F.col("_fresh")) & (F.col("user_key") == F.col("_k")), "left")
    truth = truth.groupBy("probe_id").agg(F.max(F.col("_fresh").isNull()).alias("yes"))
    both = truth.join(ledger, F.col("probe_id") == F.col("_yes"), "left")
    says = F.col("_yes").isNotNull()
    return _with_rate(
        both.agg(F.lit("ledger").alias("answered_by"), F.count(F.lit(1)).alias("asked"), F.count_if(says & ~F.col("yes")).alias("wrong_yes"), F.count_if(~says & F.col("yes")).alias("wrong_no"))
    )


def filter_errors(filter_keys: DataFrame, filter_blocks: DataFrame, probes: DataFrame) -> DataFrame:
    """Measured wrong answers, one row for each who answers.

    ``ledger`` and ``filters, own keys`` as above.
    ``filters, probes``: every distinct probe key against every filter; a yes for a key not in the block is
    wrong. The pairs grow as keys times filters.
    ``filters, any``: every distinct probe key, asked whether any filter says yes; wrong for a key in no block.
    """
    blocks = _stored_filters(filter_blocks)
    pairs = _own_pairs(filter_keys, blocks)
    keys = probes.where(F.col("user_key").isNotNull()).select(F.col("user_key").alias("key")).distinct()
    members = pairs.join(keys, "key", "left_semi").select("key", key_may_match(F.col("key").cast("binary"), F.col("filter")).alias("yes"))
    marked = keys.join(members.select(F.col("key").alias("_in")).distinct(), F.col("key") == F.col("_in"), "left").select("key", F.col("_in").isNotNull().alias("inside"))
    inside = members.agg(F.count(F.lit(1)).alias("pairs"), F.count_if("yes").alias("pairs_yes"))
    n = keys.agg(F.count(F.lit(1)).alias("n_keys")).crossJoin(blocks.agg(F.count(F.lit(1)).alias("n_filters")))
    counts = _ask_all(marked, blocks).crossJoin(inside).crossJoin(n)
    answers = F.explode(
        F.array(
            F.struct(
                F.lit("filters, probes").alias("answered_by"), (F.col("n_keys") * F.col("n_filters") - F.col("pairs")).alias("asked"),
                (F.col("yes") - F.col("pairs_yes")).alias("wrong_yes"), (F.col("pairs") - F.col("pairs_yes")).alias("wrong_no"),
            ),
            F.struct(F.lit("filters, any").alias("answered_by"), F.col("n_keys").alias("asked"), F.col("outside_yes").alias("wrong_yes"), F.col("inside_no").alias("wrong_no")),
        )
    )
    both = own_key_errors(filter_keys, filter_blocks).unionByName(ledger_errors(filter_keys, probes))
    return both.unionByName(_with_rate(counts.select(answers.alias("_a")).select("_a.*")))
