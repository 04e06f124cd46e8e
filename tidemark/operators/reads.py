"""Point, multi-point, snapshot, range, prefix and reverse reads of an op-log.

The newest operation of a key at a snapshot decides, and only afterwards deletes hide their keys.
Key bounds are applied before that step, where they reach the scan; they cannot change the result,
because the step works key by key. The newest operation is found by an aggregate that Spark combines
within map tasks, so a key with most of the rows costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schema import NEWEST, PUT


def visible(log: DataFrame, snapshot: int | Column = NEWEST) -> DataFrame:
    """Operations that a snapshot sees."""
    return log if isinstance(snapshot, int) and snapshot >= NEWEST else log.where(F.col("seq") <= snapshot)


def newest(log: DataFrame, snapshot: int | Column = NEWEST) -> DataFrame:
    """The newest visible operation of each key, deletes too: user_key, seq, op, value."""
    last = lambda c: F.max_by(F.col(c), F.col("seq")).alias(c)
    return visible(log, snapshot).groupBy("user_key").agg(F.max("seq").alias("seq"), last("op"), last("value"))


def scan(log: DataFrame, snapshot: int | Column = NEWEST) -> DataFrame:
    """Live rows at a snapshot: user_key, seq, value."""
    return newest(log, snapshot).where(F.col("op") == PUT).select("user_key", "seq", "value")


def get(log: DataFrame, key, snapshot: int | Column = NEWEST) -> DataFrame:
    """The live row of one key, or none: never written and deleted keys are alike."""
    return scan(log.where(F.col("user_key") == F.lit(key)), snapshot)


def multi_get(log: DataFrame, keys: DataFrame, snapshot: int | Column = NEWEST, *, key: str = "user_key") -> DataFrame:
    """Each asked key once with ``found`` and the value; null keys are not asked.

    Only operations on asked keys are aggregated. Neither side is broadcast by this operator: Spark
    does so itself when it knows that a side is small.
    """
    asked = keys.where(F.col(key).isNotNull()).select(F.col(key).alias("_asked")).distinct()
    mine = log.join(asked, log["user_key"] == asked["_asked"], "left_semi")
    rows = scan(mine, snapshot)
    return asked.join(rows, F.col("_asked") == F.col("user_key"), "left").select(F.col("_asked").alias("user_key"), F.col("seq").isNotNull().alias("found"), "seq", "value")


def range_scan(log: DataFrame, lo=None, hi=None, snapshot: int | Column = NEWEST) -> DataFrame:
    """Live rows with lo <= key < hi; None is an open end."""
    if lo is not None:
        log = log.where(F.col("user_key") >= F.lit(lo))
    if hi is not None:
        log = log.where(F.col("user_key") < F.lit(hi))
    return scan(log, snapshot)


def successor(prefix):
    """Least key above every key with the prefix, None when there is none."""
    raw = prefix.encode() if isinstance(prefix, str) else bytes(prefix)
    raw = raw.rstrip(b"\xff")
    return raw[:-1] + bytes([raw[-1] + 1]) if raw else None


def prefix_scan(log: DataFrame, prefix, snapshot: int | Column = NEWEST) -> DataFrame:
    """Live rows whose key begins with ``prefix``; text keys use the pushed-down starts-with."""
    if isinstance(prefix, str):
        return scan(log.where(F.col("user_key").startswith(prefix)), snapshot)
    return range_scan(log, prefix, successor(prefix), snapshot)


def seek_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy("user_key").limit(1)


def seek_last(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("user_key")).limit(1)


def seek(rows: DataFrame, target) -> DataFrame:
    """First live row whose key is not below ``target``."""
    return seek_first(rows.where(F.col("user_key") >= F.lit(target)))


def next_rows(rows: DataFrame, current, n: int = 1) -> DataFrame:
    """The ``n`` live rows after the key."""
    return rows.where(F.col("user_key") > F.lit(current)).orderBy("user_key").limit(n)


def prev_rows(rows: DataFrame, current, n: int = 1) -> DataFrame:
    """The ``n`` live rows before the key, nearest first."""
    return rows.where(F.col("user_key") < F.lit(current)).orderBy(F.desc("user_key")).limit(n)


def snapshot_diff(log: DataFrame, old: int | Column, new: int | Column) -> DataFrame:
    """Live rows at ``new`` that were not the same at ``old``. Only keys written in between can differ."""
    written = log.where((F.col("seq") > old) & (F.col("seq") <= new)).select(F.col("user_key").alias("_k")).distinct()
    now = scan(log.join(written, log["user_key"] == written["_k"], "left_semi"), new)
    return now.where(F.col("seq") > old)
