"""Compaction: which operations may be dropped without changing what any live snapshot sees.

With ``newer`` the seq of the next newer operation of the same key within the inputs:

1. drop an operation when ``newer`` <= the smallest live snapshot: every reader sees the newer one;
2. drop a delete at or below that snapshot when no deeper level can hold the key: it hides nothing.

``newer`` is taken over all rows, dropped or not. One key may hold any share of the rows: rule 1 keeps at
most one operation at or below the snapshot, the newest, which an aggregate finds; operations above it
all stay. No window over a key's rows is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.order import interval_sums
from tidemark.schema import DELETE


def keep(log: DataFrame, smallest_snapshot: int | Column, *, covered: DataFrame | None = None) -> DataFrame:
    """Operations that a compaction of all of ``log`` keeps (distinct by key and seq).

    ``covered``: user_key of the keys that deeper levels may hold; None means that there is none deeper.
    """
    above = log.where(F.col("seq") > smallest_snapshot)
    below = log.where(F.col("seq") <= smallest_snapshot)
    others = [c for c in log.columns if c not in ("user_key", "seq")]
    last = below.groupBy("user_key").agg(F.max("seq").alias("seq"), *[F.max_by(F.col(c), F.col("seq")).alias(c) for c in others])
    if covered is None:
        last = last.where(F.col("op") != DELETE)
    else:
        held = covered.select(F.col("user_key").alias("_held"), F.lit(True).alias("_deep")).distinct()
        last = last.join(held, F.col("user_key") == F.col("_held"), "left").where((F.col("op") != DELETE) | F.col("_deep").isNotNull())
    return above.unionByName(last.select(*log.columns))


def deletes_at_base_level(deletes: DataFrame, deeper: DataFrame) -> DataFrame:
    """Deletes whose key lies in the range of no deeper file."""
    counted = interval_sums(deletes, F.col("user_key"), F.col("user_key"), deeper, {"n_deeper": F.lit(1).cast("long")})
    return counted.where("n_deeper = 0").drop("n_deeper")

