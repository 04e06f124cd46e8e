"""A few keys holding most records: per-key results by value-frequency compression.

Rows are grouped by (key, value) before they are grouped by key. A hot key's rows so spread over as
many groups as it has values and shrink to one weighted row each; counts, sums, distinct counts, modes
and percentiles of the key then come from the weighted values, exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import written

WEIGHT = "n_rows"


def value_frequencies(df: DataFrame, key: Sequence[str], value: Sequence[str], **more: Column) -> DataFrame:
    """One row for each distinct (key, value) with its number of rows ``n_rows``; ``more`` adds aggregates."""
    return df.groupBy(*key, *value).agg(F.count(F.lit(1)).alias(WEIGHT), *[c.alias(name) for name, c in more.items()])


def weighted_percentiles(freq: DataFrame, key: Sequence[str], value: str, ps: dict[str, float], *, digit_bits: int = 11, value_bits: int = 33) -> DataFrame:
    """Exact discrete percentiles of non-negative integers below 2**value_bits, one column for each of ``ps``.

    The percentile p is the least value v such that at least p of the key's rows have a value <= v. Found
    digit by digit: at each level weights are summed by the next digit, and the digit that holds the
    wanted rank is kept. A window so sees at most 2**digit_bits rows of one (key, percentile), however
    many values the key has. Values out of range raise an error instead of giving a wrong result.
    """
    key = list(key)
    levels = -(-value_bits // digit_bits)
    limit = 1 << (levels * digit_bits)
    v = F.col(value).cast("long")
    checked = F.when((v < 0) | (v >= limit), F.raise_error(F.lit(f"{value} is out of range"))).otherwise(v)
    rows = freq.where(F.col(value).isNotNull()).select(*key, checked.alias("_v"), F.col(WEIGHT).alias("_w"))
    shift = (levels - 1) * digit_bits
    names = list(ps)
    total = rows.groupBy(*key, F.shiftright("_v", shift).alias("_prefix")).agg(F.sum("_w").alias("_w"))
    by_key = Window.partitionBy(*key)
    total = total.withColumn("_n", F.sum("_w").over(by_key))
    ranks = F.explode(F.array(*[F.struct(F.lit(n).alias("_p"), F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(ps[n]))).cast("long").alias("_rank")) for n in names]))
    digits = total.select(*key, "_prefix", "_w", ranks.alias("_r")).select(*key, "_prefix", "_w", "_r._p", "_r._rank")
    for level in range(levels):
        w = Window.partitionBy(*key, "_p").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = digits.withColumn("_upto", F.sum("_w").over(w))
        held = upto.where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_w") < F.col("_rank")))
        held = held.select(*key, "_p", "_prefix", (F.col("_rank") - (F.col("_upto") - F.col("_w"))).alias("_rank"))
        if level == levels - 1:
            return held.groupBy(*key).pivot("_p", names).agg(F.first("_prefix"))
        shift -= digit_bits
        fine = rows.groupBy(*key, F.shiftright("_v", shift).alias("_prefix")).agg(F.sum("_w").alias("_w"))
        inner = fine.withColumn("_up", F.shiftright("_prefix", digit_bits))
        renamed = held.select(*[F.col(k).alias(f"_k_{k}") for k in key], "_p", F.col("_prefix").alias("_held"), "_rank")
        on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key] + [F.col("_up") == F.col("_held")]
        digits = inner.join(renamed, on).select(*key, "_p", "_prefix", "_w", "_rank")
    raise AssertionError("unreachable")


def key_statistics(df: DataFrame, *, group: Sequence[str] = (), key: str = "user_key", op: str = "op", value: str = "value", order: str = "seq", put: int = 1, delete: int = 0) -> DataFrame:
    """Rows, puts, deletes, bytes of values and newest order of each key, from value sizes with frequencies.

    Nulls: rows without key are left out; an unknown or null operation counts as a row only; a null
    value has no bytes; a null order is not the newest. Repeated rows count as stored. Empty table: no
    rows. One key may hold any share of the rows.
    """
    cols = [*group, key]
    sized = df.where(F.col(key).isNotNull()).select(*cols, F.col(op).alias("_op"), F.octet_length(value).alias("_size"), F.col(order).alias("_order"))
    freq = value_frequencies(sized, cols, ["_op", "_size"], _newest=F.max("_order"))
    return freq.groupBy(*cols).agg(
        F.sum(WEIGHT).alias("n_rows"),
        F.sum(F.when(F.col("_op") == put, F.col(WEIGHT)).otherwise(0)).alias("n_puts"),
        F.sum(F.when(F.col("_op") == delete, F.col(WEIGHT)).otherwise(0)).alias("n_deletes"),
        F.sum(F.coalesce(F.col("_size").cast("long") * F.col(WEIGHT), F.lit(0))).alias("value_bytes"),
        F.max("_newest").alias("newest_seq"),
    )


def heavy_keys(stats: DataFrame, *, group: str, share: float = 0.01) -> DataFrame:
    """Rows of ``key_statistics`` whose key has more than ``share`` of the rows of its group."""
    totals = stats.groupBy(F.col(group).alias("_group")).agg(F.sum("n_rows").alias("_total"))
    return stats.join(totals, F.col(group) == F.col("_group")).where(F.col("n_rows") > F.lit(share) * F.col("_total")).drop("_group", "_total")


def value_profile(df: DataFrame, *, group: Sequence[str] = (), key: str = "user_key", value: str = "value") -> DataFrame:
    """Distinct values, and mode, median and 95th percentile of the value sizes of each key; null values left out.

    A key whose values are all null is not in the result.
    """
    cols = [*group, key]
    by_value = value_frequencies(df.where(F.col(key).isNotNull() & F.col(value).isNotNull()), cols, [value])
    by_size = by_value.withColumn("_size", F.octet_length(value).cast("long")).groupBy(*cols, "_size").agg(F.sum(WEIGHT).alias(WEIGHT), F.count(F.lit(1)).alias("_values"))
    by_size = written(by_size, "value-sizes")  # read once for the counts and once for each digit of the percentiles
    counts = by_size.groupBy(*cols).agg(
        F.sum("_values").alias("n_values"), F.max(F.struct(F.col(WEIGHT), (-F.col("_size")).alias("v"))).alias("_best")
    ).select(*cols, "n_values", (-F.col("_best.v")).alias("mode_bytes"))
    # digits above those of the greatest size are zero for every value
    greatest = by_size.agg(F.max("_size")).first()[0] or 0
    percentiles = weighted_percentiles(by_size, cols, "_size", {"p50_bytes": 0.5, "p95_bytes": 0.95}, value_bits=max(1, greatest.bit_length()))
    return counts.join(percentiles, cols)
