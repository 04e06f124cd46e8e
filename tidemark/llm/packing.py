"""Filling containers of fixed capacity with texts, each container mixed from the sources in proportion.

Deficit round-robin: every source has a queue of its items and an account. For each container the
accounts get their shares of the capacity; a source places the next item of its queue when its account
covers at least half of it, and is charged for the whole, so that surpluses and deficits are carried to
the next container. The last part of a container is filled exactly by one or two items, from the sources
to which most is owed. Queues are not sorted by length but hold long and short items in even mixture, and
the shares follow what is left of each source, so that the last containers are mixed like the first.

Shards are packed in parallel. Every source is dealt to the shards in equal parts, so that each shard has
the proportions of the whole but for a bucket of each source. What a shard leaves on the accounts is known
beforehand, as target share of its tokens minus tokens of the source; prefix sums over the shards give each
one the accounts that the shards before it leave.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import written

CAPACITY = 2048
#: Tokens of a shard, about; one task packs it in memory.
SHARD_TOKENS = 2_000_000
#: Parts in which a source is dealt to the shards, for each shard.
BUCKETS_A_SHARD = 16
#: Rows of one task of a prefix sum.
SUM_BLOCK = 4096
#: No known source.
UNKNOWN = "(none)"
_OUT = "row long, doc_id long, source string, piece int, start_token long, n_tokens int, container long, carried double"
_GOLDEN = (math.sqrt(5) - 1) / 2


class _Queue:
    """Items of one source: in an order that mixes lengths evenly, and by length."""

    def __init__(self, items: Iterable[tuple[int, object]]):
        items = sorted(items, key=lambda x: x[0])
        # multiples of the golden ratio fall evenly, so every part of the queue has all lengths in proportion
        order = sorted(range(len(items)), key=lambda i: (i + 1) * _GOLDEN % 1.0)
        self.line = [items[i][0] for i in order]
        self.at = 0
        self.gone: dict[int, int] = {}  # taken out of turn: length and number
        self.by_length: dict[int, list] = {}
        for length, item in items:
            self.by_length.setdefault(length, []).append(item)
        self.lengths = sorted(self.by_length)
        self.tokens = sum(self.line)

    def head(self) -> int:
        """Length of the next item in turn; the queue is not empty."""
        while self.gone.get(self.line[self.at], 0):
            self.gone[self.line[self.at]] -= 1
            self.at += 1
        return self.line[self.at]

    def take(self, length: int):
        """An item of this length, in turn or not."""
        if self.head() == length:
            self.at += 1
        else:
            self.gone[length] = self.gone.get(length, 0) + 1
        items = self.by_length[length]
        item = items.pop()
        if not items:
            del self.by_length[length]
            self.lengths.pop(bisect_right(self.lengths, length) - 1)
        self.tokens -= length
        return item

    def largest(self, room: float) -> int:
        """Greatest length within ``room``; 0 when there is none."""
        i = bisect_right(self.lengths, room)
        return self.lengths[i - 1] if i else 0


def pack_shard(items: list[tuple], shares: dict[str, float] | None, accounts: dict[str, float], capacity: int) -> Iterator[tuple[list[tuple], dict[str, float]]]:
    """Containers of (source, length, item), each with the accounts after it. ``items`` are such triples, lengths from 1 to ``capacity``.

    ``shares`` None follows what is left of each source.
    """
    by_source: dict[str, list] = {}
    for source, length, item in items:
        by_source.setdefault(source, []).append((length, item))
    queues = {s: _Queue(of) for s, of in sorted(by_source.items())}
    account = {s: accounts.get(s, 0.0) for s in queues}
    reserve = capacity // 16
    left = sum(q.tokens for q in queues.values())
    while queues:
        weights = {s: q.tokens if shares is None else shares.get(s, 0.0) for s, q in queues.items()}
        weight = sum(weights.values())
        for s in queues:
            account[s] += min(capacity, left) * (weights[s] / weight if weight > 0 else 1 / len(queues))
        room, container = capacity, []

        def place(s: str, length: int) -> None:
            nonlocal room, left
            container.append((s, length, queues[s].take(length)))
            account[s] -= length
            room -= length
            left -= length
            if not queues[s].tokens:
                del queues[s]

        placed = True
        while placed and room > reserve:  # one round over the sources, long items first
            placed = False
            for head, _, s in sorted((-queues[s].head(), -account[s], s) for s in queues if queues[s].head() <= min(room, 2 * account[s])):
                rest = room + head
                if room > reserve and (rest == 0 or rest >= reserve // 4):
                    place(s, -head)
                    placed = True
        while room and queues:
            order = sorted(queues, key=lambda s: (-account[s], s))
            if exact := _exact(queues, order, room):
                for s, length in exact:
                    place(s, length)
                break
            fits = ((s, queues[s].largest(min(room, 2 * account[s]))) for s in order) if room > reserve else ()
            s, length = next((x for x in fits if x[1]), (None, 0))
            if not length:
                length, _, s = max((queues[s].largest(room), account[s], s) for s in order)
            if not length:
                break
            place(s, length)
        yield container, dict(account)


def _exact(queues: dict[str, _Queue], order: list[str], room: int) -> list[tuple[str, int]] | None:
    """One or two items that fill ``room`` exactly, from the sources that stand first in ``order``.

    Of two, those of most equal lengths are taken, which spares the shortest items for rooms that only they fill.
    """
    for s in order:
        if room in queues[s].by_length:
            return [(s, room)]
    n = len(order)
    for total in range(2 * n - 1):
        for i in range(max(0, total - n + 1), total // 2 + 1):
            s, t = order[i], order[total - i]
            a, b = queues[s].by_length, queues[t].by_length
            few, many = (a, b) if len(a) <= len(b) else (b, a)
            found = [x for x in few if room - x in many and (s != t or 2 * x != room or len(a[x]) > 1)]
            if found:
                x = min(found, key=lambda x: (abs(2 * x - room), x))
                return [(s, x), (t, room - x)] if few is a else [(s, room - x), (t, x)]
    return None


def sums_before(df: DataFrame, by: list[str], at: str, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of equal ``by`` whose ``at``, a number from 0, is less.

    Blocks of ``SUM_BLOCK`` are summed each by itself, then the blocks, so no task sorts all rows of a group.
    """
    block = F.floor(F.col(at) / SUM_BLOCK).alias("_block")
    d = df.withColumn("_block", block)
    upto = Window.unboundedPreceding, -1
    totals = d.groupBy(*by, "_block").agg(F.sum(value).alias("_sum"))
    earlier = F.coalesce(F.sum("_sum").over(Window.partitionBy(*by).orderBy("_block").rowsBetween(*upto)), F.lit(0))
    totals = totals.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_block").alias("_of"), earlier.alias("_earlier"))
    d = d.withColumn("_within", F.coalesce(F.sum(value).over(Window.partitionBy(*by, "_block").orderBy(at).rowsBetween(*upto)), F.lit(0)))
    on = F.col("_block") == F.col("_of")
    for c in by:
        on = on & (F.col(c) == F.col(f"_by_{c}"))
    return d.join(totals, on).select(*df.columns, (F.col("_within") + F.col("_earlier")).alias(name))


def _deal(items: DataFrame, shards: int) -> DataFrame:
    """``items`` with their ``shard``: each source, cut into buckets by hash, goes to the shards in parts of equal tokens."""
    items = items.withColumn("bucket", F.pmod(F.xxhash64("id", F.lit(17)), F.lit(shards * BUCKETS_A_SHARD)))
    parts = items.groupBy("source", "bucket").agg(F.sum("rest").alias("n"))
    whole = parts.groupBy(F.col("source").alias("_s")).agg(F.sum("n").alias("_whole"))
    parts = sums_before(parts, ["source"], "bucket", "n", "before").join(whole, F.col("source") == F.col("_s"))
    middle = F.floor((F.col("before") + F.col("n") / 2) * shards / F.col("_whole"))
    shard = F.when(F.col("_whole") > 0, F.least(middle, F.lit(shards - 1))).otherwise(F.pmod("bucket", F.lit(shards)))
    dealt = parts.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), shard.cast("long").alias("shard"))
    return items.join(dealt, (F.col("source") == F.col("_s")) & (F.col("bucket") == F.col("_b"))).drop("_s", "_b", "bucket")


def _accounts(items: DataFrame, shares: DataFrame) -> DataFrame:
    """shard, source, owed: what the shards before leave on the account of each source that a shard has."""
    per = items.groupBy("shard", "source").agg(F.sum("rest").alias("n"))
    own = sums_before(per, ["source"], "shard", "n", "own")
    every = per.groupBy("shard").agg(F.sum("n").alias("n")).withColumn("_all", F.lit(0))
    every = sums_before(every, ["_all"], "shard", "n", "before").select(F.col("shard").alias("_shard"), "before")
    own = own.join(every, F.col("shard") == F.col("_shard")).join(shares.select(F.col("source").alias("_s"), "share"), F.col("source") == F.col("_s"), "left")
    return own.select("shard", "source", (F.coalesce("share", F.lit(0.0)) * F.col("before") - F.col("own")).alias("owed"), "share")


def pack(sized: DataFrame, *, shares: dict[str, float] | None = None, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Every item's place: row, doc_id, source, piece, start_token, n_tokens, container, carried.

    ``sized`` has row, doc_id, source, n_tokens (``tokens.sized``). ``shares``: target proportion of each
    source in every container; None takes the proportions of the input, with which all queues last to
    the end. With other shares the sources that are plenty fill the last containers; one without a share
    places its items in the room that is left. ``carried``: what the account of the item's source holds
    after its container.

    Only an item longer than the capacity is cut: into full containers of its own and one rest that is
    packed like an item. Items of no tokens (also of null texts) have no container and no place. A null
    source counts as a source of its own. Repeated rows are packed as often as they occur, and as items
    of their own: neither shards nor containers are told by what they hold.
    """
    # written before the filter, which would otherwise count the tokens a second time; the file also fixes the ids
    items = sized.select("row", "doc_id", F.coalesce("source", F.lit(UNKNOWN)).alias("source"), F.col("n_tokens").cast("long").alias("n_tokens"), F.monotonically_increasing_id().alias("id"))
    items = written(items, "packing-items").where("n_tokens > 0").withColumn("rest", F.col("n_tokens") % capacity)
    in_all = items.agg(F.sum("n_tokens"), F.sum("rest")).first()
    shards = max(1, math.ceil((in_all[1] or 0) / shard_tokens))
    if shares is None:
        wanted = items.groupBy("source").agg((F.sum("n_tokens") / F.lit(float(in_all[0] or 1))).alias("share"))
    else:
        wanted = items.sparkSession.createDataFrame(list(shares.items()), "source string, share double")
    items = written(_deal(items, shards), "packing-dealt")
    accounts = written(_accounts(items, wanted), "packing-accounts")

    def place(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["rest", "row", "doc_id"], kind="stable").reset_index(drop=True)
        owed = dict(zip(right["source"], right["owed"].astype(float)))
        target = None if shares is None else dict(zip(right["source"], right["share"].fillna(0.0)))
        packed = left[left["rest"] > 0]
        base = int(left["shard"].iloc[0]) << 32 if len(left) else 0
        at, carried, number = {}, {}, -1
        for number, (container, account) in enumerate(pack_shard(list(zip(packed["source"], packed["rest"].astype(int), packed.index)), target, owed, capacity)):
            for s, _, i in container:
                at[i], carried[i] = base + number, account[s]
        rows = [
            (r.row, r.doc_id, r.source, r.n_tokens // capacity, r.n_tokens - r.rest, r.rest, at[r.Index], carried[r.Index]) for r in packed.itertuples()
        ]
        for r in left[left["n_tokens"] >= capacity].itertuples():
            for piece in range(r.n_tokens // capacity):
                number += 1
                rows.append((r.row, r.doc_id, r.source, piece, piece * capacity, capacity, base + number, None))
        return pd.DataFrame(rows, columns=["row", "doc_id", "source", "piece", "start_token", "n_tokens", "container", "carried"]).astype({"doc_id": "Int64", "row": "Int64", "carried": "float64"})

    return items.groupBy("shard").cogroup(accounts.groupBy("shard")).applyInPandas(place, _OUT)


def _per_source(places: DataFrame) -> DataFrame:
    return places.groupBy("container", "source").agg(F.count(F.lit(1)).alias("n_items"), F.sum("n_tokens").alias("n_tokens"), F.max("carried").alias("carried"))


def mixture(places: DataFrame) -> DataFrame:
    """container, source, n_tokens, target_tokens, carried: what a container holds of each source in it.

    The target is the source's share of all tokens; ``carried`` is null for full pieces of a cut item,
    which have a container of their own.
    """
    per = _per_source(places)
    share = per.groupBy(F.col("source").alias("_s")).agg(F.sum("n_tokens").alias("_n"))
    whole = share.agg(F.sum("_n")).scalar()
    size = per.groupBy(F.col("container").alias("_c")).agg(F.sum("n_tokens").alias("_size"))
    out = per.join(share, F.col("source") == F.col("_s")).join(size, F.col("container") == F.col("_c"))
    return out.select("container", "source", "n_tokens", (F.col("_n") / whole * F.col("_size")).alias("target_tokens"), "carried")


def containers(places: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Each container with its number of items, tokens, room left, fill, and how far it is off the target proportions.

    ``off_target`` is half the sum over all sources of the differences between the source's share of the
    container and of all tokens: 0 when they are equal, towards 1 when the container holds a rare source only.
    """
    m = mixture(places).withColumn("_off", F.abs(F.col("n_tokens") - F.col("target_tokens")))
    n = F.sum("n_tokens")
    off = m.groupBy(F.col("container").alias("_c")).agg(((F.sum("_off") + n - F.sum("target_tokens")) / (2 * n)).alias("off_target"))
    all_of = places.groupBy("container").agg(F.count(F.lit(1)).alias("n_items"), n.alias("n_tokens"), (F.lit(capacity) - n).alias("room_left"), (n / capacity).alias("fill"), F.max("carried").isNull().alias("cut"))
    return all_of.join(off, F.col("container") == F.col("_c")).drop("_c")


def overfull(places: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers that hold more than the capacity: there are none."""
    return places.groupBy("container").agg(F.sum("n_tokens").alias("n_tokens")).where(F.col("n_tokens") > capacity)


def cut_documents(places: DataFrame) -> DataFrame:
    """doc_id of the documents in more than one container."""
    return places.groupBy("row", "doc_id").agg(F.count_distinct("piece").alias("n")).where("n > 1").select("doc_id").distinct()
