"""Merging sorted runs: union, then one order by key and newest first. Nothing is dropped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.order import positions
from tidemark.schema import LEVELS


def internal_order(reverse: bool = False) -> list[Column]:
    """Key ascending and newer first; all the other way in reverse."""
    return [F.desc("user_key"), F.asc("seq")] if reverse else [F.asc("user_key"), F.desc("seq")]


def merge_runs(runs: list[DataFrame]) -> DataFrame:
    """All rows of all runs, in any order; order the result, or ``ranked`` it, as needed."""
    return reduce(lambda a, b: a.unionByName(b), runs)


def ranked(rows: DataFrame, reverse: bool = False, name: str = "position") -> DataFrame:
    """Rows with their position in internal order."""
    return positions(rows, internal_order(reverse), name)


def concat_level(log: DataFrame, files: DataFrame, level: int) -> DataFrame:
    """Rows stored in the files of one level."""
    mine = files.where(F.col("level") == level).select(F.col("file_number").alias("_file"))
    return log.join(mine, log["file_number"] == mine["_file"], "left_semi")


def run_count(files: DataFrame) -> DataFrame:
    """Number of runs a reader merges: every file of level 0, and one for each deeper level with files."""
    return files.agg((F.count_if(F.col("level") == 0) + F.count_distinct(F.when(F.col("level").between(1, LEVELS - 1), F.col("level")))).alias("n_runs"))
