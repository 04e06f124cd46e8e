"""The op-log: user_key, seq, op, value. Keys compare byte by byte, newer operations have greater seq."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELETE, PUT = 0, 1
#: Sequence number that is newer than any other.
NEWEST = (1 << 63) - 1
LEVELS = 7

OPLOG = T.StructType([T.StructField("user_key", T.BinaryType()), T.StructField("seq", T.LongType()), T.StructField("op", T.ByteType()), T.StructField("value", T.BinaryType())])
FILES = "level int, file_number long, size long, lo_key string, lo_seq long, hi_key string, hi_seq long"


def oplog(df: DataFrame, *, key: str | Column = "user_key", seq: str | Column = "seq", op: str | Column = "op", value: str | Column = "value", once: bool = True) -> DataFrame:
    """Any table of operations as an op-log; rows that are no operation are left out, repeated ones kept once.

    Reads absorb repeated rows anyway: for them ``once=False`` saves the shuffle that finds such rows.

    A delete carries no value. Orders above the greatest 64-bit number fail on the cast instead of wrapping.
    """
    c = lambda x: F.col(x) if isinstance(x, str) else x
    rows = df.select(c(key).alias("user_key"), c(seq).cast("long").alias("seq"), c(op).cast("int").alias("op"), c(value).alias("value"))
    rows = rows.where("user_key IS NOT NULL AND seq IS NOT NULL AND op IN (0, 1)")
    rows = rows.withColumn("value", F.when(F.col("op") == PUT, F.col("value")))
    return rows.distinct() if once else rows


def parse_op(code: Column) -> Column:
    """The operation of a code; another code is an error, null is null."""
    return F.when(code == DELETE, "Delete").when(code == PUT, "Put").when(code.isNotNull(), F.raise_error(F.concat(F.lit("unknown operation "), code.cast("string"))))
