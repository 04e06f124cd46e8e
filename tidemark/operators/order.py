"""Positions and running sums over a total order without a single-task window.

Rows are range-partitioned and sorted, written once (range bounds are sampled, so a second evaluation
could cut them elsewhere), summed within their partition, and shifted by the totals of the partitions
before, of which there is one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import written

_PART, _AT = "_part", "_at"


def _sorted_runs(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    runs = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    return written(runs.select("*", F.shiftright(at, 33).alias(_PART), at.bitwiseAND((1 << 33) - 1).alias(_AT)), name)


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each of ``sums``, the sum over the rows up to and including this one in ``order``.

    Rows that are equal in ``order`` stand in any order. Nulls are summed as nothing.
    """
    runs = _sorted_runs(df.withColumns({f"_v_{k}": F.coalesce(v, F.lit(0)) for k, v in sums.items()}), order, "running")
    totals = runs.groupBy(_PART).agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    shifts = totals.select(F.col(_PART).alias("_p"), *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_s_{k}") for k in sums])
    within = Window.partitionBy(_PART).orderBy(_AT).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = runs.withColumns({f"_w_{k}": F.sum(f"_v_{k}").over(within) for k in sums}).join(shifts, F.col(_PART) == F.col("_p"))
    return out.select(*df.columns, *[(F.col(f"_w_{k}") + F.col(f"_s_{k}")).alias(k) for k in sums])


def positions(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``df`` with the position of each row in ``order``, from 1.

    The place of a row in its sorted run is known when the run is written; only the runs' shifts, one row
    a partition, are joined to it.
    """
    runs = _sorted_runs(df, order, "positions")
    totals = runs.groupBy(_PART).agg(F.count(F.lit(1)).alias("_t"))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    shifts = totals.select(F.col(_PART).alias("_p"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_s"))
    out = runs.join(F.broadcast(shifts), F.col(_PART) == F.col("_p"))  # no more rows than shuffle partitions
    return out.select(*df.columns, (F.col(_AT) + 1 + F.col("_s")).alias(name))


def neighbours(df: DataFrame, key: str) -> DataFrame:
    """Each row of ``df`` (distinct keys) with the key before and after it; null at the ends."""
    runs = _sorted_runs(df, [F.col(key)], "neighbours")
    ends = runs.groupBy(_PART).agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    by_part = Window.orderBy(_PART)  # one row a partition
    ends = ends.select(F.col(_PART).alias("_p"), F.lag("_hi").over(by_part).alias("_before"), F.lead("_lo").over(by_part).alias("_after"))
    within = Window.partitionBy(_PART).orderBy(_AT)
    near = runs.withColumns({"_prev": F.lag(key).over(within), "_next": F.lead(key).over(within)})
    out = near.join(F.broadcast(ends), F.col(_PART) == F.col("_p"))
    return out.select(*df.columns, F.coalesce("_prev", "_before").alias("prev_key"), F.coalesce("_next", "_after").alias("next_key"))


def islands(df: DataFrame, lo: str, hi: str, order: list[Column], name: str = "island") -> DataFrame:
    """Intervals with the least ``lo`` of the chain of overlapping ones that each belongs to; ends that touch overlap.

    Intervals with a null end are left out. ``order`` begins with ``lo``. One pass over sorted runs; what the
    runs before reach, one row a partition, is joined to each.
    """
    rows = _sorted_runs(df.where(F.col(lo).isNotNull() & F.col(hi).isNotNull()), order, "islands")
    upto = Window.partitionBy(_PART).orderBy(_AT).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = Window.partitionBy(_PART).orderBy(_AT).rowsBetween(Window.unboundedPreceding, -1)

    def greatest(rows: DataFrame, c: str, within, out: str) -> DataFrame:
        """``rows`` with the greatest value of a column up to them: in their run, and in the runs before."""
        earlier = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
        runs = rows.groupBy(_PART).agg(F.max(c).alias("_m")).select(F.col(_PART).alias("_p"), F.max("_m").over(earlier).alias("_earlier"))
        joined = rows.join(F.broadcast(runs), F.col(_PART) == F.col("_p"))
        return joined.withColumn(out, F.greatest(F.max(c).over(within), F.col("_earlier"))).drop("_p", "_earlier")

    rows = greatest(rows, hi, above, "_reach")
    rows = rows.withColumn("_start", F.when(F.col("_reach").isNull() | (F.col(lo) > F.col("_reach")), F.col(lo)))
    return greatest(rows, "_start", upto, name).select(*df.columns, name)


def interval_sums(points: DataFrame, lo: Column, hi: Column, intervals: DataFrame, weights: dict[str, Column], *, group: str | None = None, interval_lo: str = "lo_key", interval_hi: str = "hi_key") -> DataFrame:
    """For each row of ``points`` the sums of ``weights`` over the intervals that overlap [lo, hi], ends included.

    An interval overlaps unless it ends before lo or begins after hi, so the sum is the weight of the
    intervals that begin by hi less that of the intervals that end before lo: two running sums in one pass
    over one sorted union instead of a join of ranges. A null lo or hi is an open end. ``group`` names a column
    (in both) within which rows are matched. Intervals with a null bound are left out.
    """
    rows = points.withColumn("_id", F.monotonically_increasing_id())
    rows = written(rows.withColumns({"_lo": lo, "_hi": hi}), "points")
    g = F.col(group).cast("long") if group else F.lit(0).cast("long")
    ends = intervals.where(F.col(interval_lo).isNotNull() & F.col(interval_hi).isNotNull()).select(g.alias("_g"), F.col(interval_lo).alias("_ilo"), F.col(interval_hi).alias("_ihi"), *[v.alias(k) for k, v in weights.items()])
    none = {k: F.lit(0).cast("long") for k in weights}
    both = lambda at, rank, side: ends.select("_g", F.col(at).alias("_k"), F.lit(rank).alias("_rank"), F.lit(None).cast("long").alias("_id"), *[(F.col(k) if x == side else none[k]).alias(f"{x}_{k}") for x in "be" for k in weights])
    ask = lambda at, rank: rows.select(g.alias("_g"), F.col(at).alias("_k"), F.lit(rank).alias("_rank"), "_id", *[none[k].alias(f"{x}_{k}") for x in "be" for k in weights]).where("_k IS NOT NULL")
    # begun by hi: beginnings sort before the question; ended before lo: the question sorts before ends
    events = both("_ilo", 0, "b").unionByName(ask("_hi", 1)).unionByName(both("_ihi", 1, "e")).unionByName(ask("_lo", 0))
    sums = {f"u{x}_{k}": F.col(f"{x}_{k}") for x in "be" for k in weights}
    answers = running_sums(events, [F.col("_g"), F.col("_k"), F.col("_rank")], sums).where("_id IS NOT NULL")
    of = lambda x, rank, k: F.max(F.when(F.col("_rank") == rank, F.col(f"u{x}_{k}"))).alias(f"{x}_{k}")
    answers = answers.groupBy(F.col("_id").alias("_aid")).agg(*[of("b", 1, k) for k in weights], *[of("e", 0, k) for k in weights])
    # running sums span the groups: what the groups before contribute is taken off
    every = ends.select("_g", *weights).unionByName(rows.select(g.alias("_g"), *[v.alias(k) for k, v in none.items()]))
    totals = every.groupBy("_g").agg(*[F.sum(k).alias(f"s_{k}") for k in weights])
    earlier = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)  # one row a group
    before = totals.select("*", *[F.coalesce(F.sum(f"s_{k}").over(earlier), F.lit(0)).alias(f"o_{k}") for k in weights])
    out = rows.join(answers, F.col("_id") == F.col("_aid"), "left").withColumn("_g", g).join(before, "_g")
    sums = []
    for k in weights:
        upto = F.coalesce(F.col(f"b_{k}") - F.col(f"o_{k}"), F.col(f"s_{k}"))
        gone = F.coalesce(F.col(f"e_{k}") - F.col(f"o_{k}"), F.lit(0))
        sums.append((upto - gone).alias(k))
    return out.select(*points.columns, *sums)
