"""Batches: sizes, group commit, and sequence numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.order import positions

MAX_GROUP_BYTES = 1 << 20
SMALL_WRITE_BYTES = 128 << 10
#: Operation and sequence number of one element.
ELEMENT_BYTES = 9


def element_size(key: str = "user_key", value: str = "value") -> Column:
    return F.lit(ELEMENT_BYTES) + F.coalesce(F.octet_length(key), F.lit(0)) + F.coalesce(F.octet_length(value), F.lit(0))


def batch_sizes(elements: DataFrame, batch: str = "batch_no") -> DataFrame:
    """Number of elements and approximate size of each batch."""
    return elements.groupBy(batch).agg(F.count(F.lit(1)).alias("n_elements"), F.sum(element_size()).alias("size"))


def group_commit(queue: DataFrame, *, order: str = "batch_no", size: str = "size", sync: str = "synchronous", max_bytes: int = MAX_GROUP_BYTES, small: int = SMALL_WRITE_BYTES) -> DataFrame:
    """The writers at the head of the queue that are committed together.

    The first leads. Followers join in order until a synchronous one stands behind a leader that is
    not, or the bytes exceed the cap: ``max_bytes``, or the leader's size plus ``small`` when the leader
    is no larger than that. A batch has at least one element, so no more than ``max_bytes`` over an
    element's size can join: only so many are taken from the queue before the running sums.
    """
    head = queue.orderBy(order).limit(max_bytes // ELEMENT_BYTES + 2)
    upto = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lead_size, lead_sync = F.first(size).over(first), F.coalesce(F.first(sync).over(first), F.lit(False))
    cap = F.when(lead_size <= small, lead_size + small).otherwise(max_bytes)
    rows = head.withColumns({"_n": F.row_number().over(upto), "_stop": ((F.sum(size).over(upto) > cap) | (F.coalesce(F.col(sync), F.lit(False)) & ~lead_sync)).cast("int")})
    rows = rows.withColumn("_stop", F.when(F.col("_n") == 1, 0).otherwise(F.col("_stop")))
    return rows.withColumn("_stopped", F.max("_stop").over(upto)).where("_stopped = 0").drop("_n", "_stop", "_stopped")


def assign_sequence(operations: DataFrame, order: list[Column], last: int) -> DataFrame:
    """Operations with ``seq`` = last + position in ``order``; fixed once, so that a retry numbers alike."""
    placed = positions(operations, order, "seq")
    return placed.withColumn("seq", F.col("seq") + F.lit(last).cast("long"))


def batch_result(elements: DataFrame, starts: DataFrame) -> DataFrame:
    """What each batch leaves for each of its keys: the last operation in order of ordinal."""
    s = starts.select(F.col("batch_no").alias("_no"), "starting_seq_number").where("starting_seq_number IS NOT NULL").distinct()
    e = elements.join(s, F.col("batch_no") == F.col("_no"))
    seq = F.col("starting_seq_number") + F.col("ordinal")
    last = lambda c: F.max_by(F.col(c), seq).alias(c)
    return e.where("user_key IS NOT NULL AND op IN (0, 1)").groupBy("batch_no", "user_key").agg(F.max(seq).alias("seq"), last("op"), last("value"))
