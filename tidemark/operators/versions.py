"""Versions of the file set: the fold of the manifest's edits, and what a planner asks of the files.

``files`` below is a frame of level, file_number, size, lo_key, lo_seq, hi_key, hi_seq.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.order import interval_sums, islands
from tidemark.schema import LEVELS
from tidemark.storage import written

MIB = 1 << 20
MAX_FILE_SIZE = 2 * MIB
#: A compaction or flush avoids overlapping more than so many files' worth two levels down.
GRANDPARENT_FILES = 10
#: A compaction's inputs may grow to so many files' worth.
EXPANDED_FILES = 25
L0_TRIGGER = 4
MAX_FLUSH_LEVEL = 2


def fold_edits(edits: DataFrame) -> DataFrame:
    """The file set after all edits: for each level and file the edit of greatest number, if it is an add.

    Of equal numbers an add counts before a delete and a greater size before a lesser one.
    """
    kind = F.lower(F.trim("kind"))
    e = edits.where(F.col("file_number").isNotNull() & F.col("edit_no").isNotNull() & kind.isin("add", "delete"))
    last = F.max(F.struct("edit_no", (kind == "add").alias("added"), "size", "lo_key", "lo_seq", "hi_key", "hi_seq")).alias("_e")
    return e.groupBy("level", "file_number").agg(last).where("_e.added").select("level", "file_number", *[F.col(f"_e.{c}").alias(c) for c in ("size", "lo_key", "lo_seq", "hi_key", "hi_seq")])


def scalars(edits: DataFrame) -> DataFrame:
    """The last scalar values of the edits: log number and last sequence number."""
    e = edits.where((F.lower(F.trim("kind")) == "scalar") & F.col("edit_no").isNotNull())
    return e.agg(F.max_by("wal_number", "edit_no").alias("wal_number"), F.max_by("prev_sequence_number", "edit_no").alias("prev_sequence_number"))


def overlapping(files: DataFrame, lo=None, hi=None) -> DataFrame:
    """Files whose key range meets [lo, hi]; None is an open end."""
    if hi is not None:
        files = files.where(F.col("lo_key") <= F.lit(hi))
    if lo is not None:
        files = files.where(F.col("hi_key") >= F.lit(lo))
    return files


def files_for_key(files: DataFrame, key) -> DataFrame:
    """Files that may hold the key, in the order a reader asks them: level 0 newest first, then level by level."""
    return overlapping(files, key, key)


def first_file_at_or_after(files: DataFrame, key) -> DataFrame:
    """For each level the file with the least greatest key that is not below ``key``."""
    least = F.min(F.struct("hi_key", (-F.col("hi_seq")).alias("s"), "file_number")).alias("_f")
    return files.where(F.col("hi_key") >= F.lit(key)).groupBy("level").agg(least).select("level", F.col("_f.file_number").alias("file_number"), F.col("_f.hi_key").alias("hi_key"))


def grown_overlap(files: DataFrame, lo=None, hi=None, level: int = 0) -> DataFrame:
    """Files of a level that meet the range, grown by the ranges of such files until nothing is added.

    Those are the files of all chains of overlapping files that meet the range: a chain covers every key
    between its ends, so one of its files meets whatever the chain meets.
    """
    chained = islands(files.where(F.col("level") == level), "lo_key", "hi_key", [F.col("lo_key"), F.col("hi_key"), F.col("file_number")])
    chained = written(chained, "chained-files")
    ends = chained.groupBy("island").agg(F.max("hi_key").alias("_to"))
    if hi is not None:
        ends = ends.where(F.col("island") <= F.lit(hi))
    if lo is not None:
        ends = ends.where(F.col("_to") >= F.lit(lo))
    return chained.join(ends.select(F.col("island").alias("_met")), F.col("island") == F.col("_met"), "left_semi").drop("island")


def key_range(files: DataFrame, by: list[str]) -> DataFrame:
    """First and last internal key of a set of files: least key with its greatest seq, greatest key with its least seq. Unknown bounds are left out."""
    return files.groupBy(*by).agg(
        F.min(F.when(F.col("lo_key").isNotNull(), F.struct("lo_key", (-F.col("lo_seq")).alias("s")))).alias("_l"), F.max(F.struct("hi_key", (-F.col("hi_seq")).alias("s"))).alias("_h")
    ).select(
        *by, F.col("_l.lo_key").alias("lo_key"), (-F.col("_l.s")).alias("lo_seq"), F.col("_h.hi_key").alias("hi_key"), (-F.col("_h.s")).alias("hi_seq")
    )


def level_scores(files: DataFrame) -> DataFrame:
    """How urgently each level asks for a compaction: level 0 by number of files over four (whole), others by bytes over 10**level MiB."""
    sums = files.where(F.col("level").between(0, LEVELS - 1)).groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    score = F.when(F.col("level") == 0, F.floor(F.col("n") / L0_TRIGGER).cast("double")).otherwise(F.col("bytes") / (F.pow(F.lit(10.0), F.col("level")) * MIB))
    return sums.select("level", score.alias("score"))


def compaction_level(files: DataFrame) -> DataFrame:
    """The level of greatest score at or above one, the lowest among equals; the last level is never picked. No row when none is due."""
    due = level_scores(files).where((F.col("level") < LEVELS - 1) & (F.col("score") >= 1))
    return due.orderBy(F.desc("score"), "level").limit(1)


def pick_round_robin(files: DataFrame, pointer) -> DataFrame:
    """For each level the first file that ends after the compaction pointer, else the level's first file."""
    order = F.struct("lo_key", (-F.col("lo_seq")).alias("s"), "file_number")
    after = F.min(F.when(F.col("hi_key") > F.lit(pointer), order))
    return files.groupBy("level").agg(F.coalesce(after, F.min(order)).alias("_f")).select("level", F.col("_f.file_number").alias("file_number"))


def flush_level(files: DataFrame, lo, hi, max_file_size: int = MAX_FILE_SIZE) -> DataFrame:
    """The level to which a flushed table with keys [lo, hi] goes.

    Level 0 when it meets level 0. Else down to at most level 2, while the next level holds nothing in
    the range and the one after it no more than ten files' worth.
    """
    met = overlapping(files, lo, hi)
    s = met.agg(*[F.count_if(F.col("level") == i).alias(f"n{i}") for i in range(4)], *[F.coalesce(F.sum(F.when(F.col("level") == i, F.col("size"))), F.lit(0)).alias(f"b{i}") for i in range(5)])
    limit = GRANDPARENT_FILES * max_file_size
    one = (F.col("n0") == 0) & (F.col("n1") == 0) & (F.col("b2") <= limit)
    two = one & (F.col("n2") == 0) & (F.col("b3") <= limit)
    return s.select(F.when(two, 2).when(one, 1).otherwise(0).alias("level"))


def overlap_with_level(files: DataFrame, down: int) -> DataFrame:
    """Each file with number (``n_down``) and bytes (``bytes_down``) of the files ``down`` levels below that meet its range.

    A file of unknown range is taken to meet none.
    """
    lower = files.withColumn("level", F.col("level") - down)
    weights = {"n_down": F.lit(1).cast("long"), "bytes_down": F.coalesce(F.col("size"), F.lit(0))}
    met = interval_sums(files, F.col("lo_key"), F.col("hi_key"), lower, weights, group="level")
    unknown = F.col("lo_key").isNull() | F.col("hi_key").isNull()
    return met.withColumns({k: F.when(unknown, 0).otherwise(F.col(k)) for k in weights})


def max_next_level_overlap(files: DataFrame) -> DataFrame:
    """Greatest number of bytes that a file below level 0 meets in the next level."""
    return overlap_with_level(files.where("level >= 1"), 1).agg(F.coalesce(F.max("bytes_down"), F.lit(0)).alias("max_bytes"))


def trivial_moves(files: DataFrame, max_file_size: int = MAX_FILE_SIZE) -> DataFrame:
    """Files that can go down a level unread: nothing there meets them, and at most ten files' worth two levels down."""
    parents = overlap_with_level(files.where(F.col("level") < LEVELS - 1), 1).select("level", "file_number", "n_down")
    grand = overlap_with_level(files, 2).select(F.col("level").alias("_l"), F.col("file_number").alias("_f"), F.col("bytes_down").alias("grandparent_bytes"))
    both = parents.join(grand, (F.col("level") == F.col("_l")) & (F.col("file_number") == F.col("_f")))
    return both.where((F.col("n_down") == 0) & (F.col("grandparent_bytes") <= GRANDPARENT_FILES * max_file_size)).select("level", "file_number", "grandparent_bytes")


def boundary_files(files: DataFrame) -> DataFrame:
    """Files below level 0 whose first user key is the last one of another file of their level, with older rows of it."""
    ends = files.where("level >= 1").select(F.col("level").alias("_l"), F.col("hi_key").alias("_k"), F.col("hi_seq").alias("_s"), F.col("file_number").alias("before_file"))
    on = (F.col("level") == F.col("_l")) & (F.col("lo_key") == F.col("_k")) & (F.col("lo_seq") < F.col("_s"))
    return files.join(ends, on).select("level", "file_number", "before_file")


def disjointness_violations(files: DataFrame) -> DataFrame:
    """Files below level 0 that meet another file of their level: file and number of others."""
    mine = files.where("level >= 1")
    met = interval_sums(mine, F.col("lo_key"), F.col("hi_key"), mine, {"n_met": F.lit(1).cast("long")}, group="level")
    return met.where("n_met > 1").select("level", "file_number", (F.col("n_met") - 1).alias("n_others"))


def live_numbers(versions: list[DataFrame]) -> DataFrame:
    """Numbers of the files that any of the versions holds."""
    out = versions[0].select("file_number")
    for v in versions[1:]:
        out = out.unionByName(v.select("file_number"))
    return out.distinct()


def obsolete_numbers(listed: DataFrame, live: DataFrame) -> DataFrame:
    """Listed files that no version holds: to be deleted."""
    held = live.select(F.col("file_number").alias("_live"))
    return listed.where("file_number IS NOT NULL").select("file_number").distinct().join(held, F.col("file_number") == F.col("_live"), "left_anti")


def summaries(files: DataFrame) -> DataFrame:
    """Each level 0 to 6 with number of files and bytes; levels without files too."""
    levels = files.sparkSession.range(LEVELS).select(F.col("id").cast("int").alias("level"))
    sums = files.groupBy(F.col("level").alias("_l")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    return levels.join(sums, F.col("level") == F.col("_l"), "left").select("level", F.coalesce("n", F.lit(0)).alias("n_files"), F.coalesce("b", F.lit(0)).alias("n_bytes"))


def level_summary(files: DataFrame) -> DataFrame:
    """One text: the numbers of files of all levels."""
    ordered = F.array_sort(F.collect_list(F.struct("level", "n_files")))  # seven rows
    text = F.array_join(F.transform(ordered, lambda x: x["n_files"].cast("string")), " ")
    return summaries(files).agg(F.concat(F.lit("files[ "), text, F.lit(" ]")).alias("summary"))


def tables_text(files: DataFrame) -> DataFrame:
    """A line for each file: level, number, size and range, as a dump of the tables shows it."""
    end = lambda k, s: F.concat(F.coalesce(k, F.lit("")), F.lit(" @ "), F.coalesce(F.col(s).cast("string"), F.lit("")))
    text = F.concat(F.col("file_number").cast("string"), F.lit(":"), F.coalesce(F.col("size").cast("string"), F.lit("")), F.lit("["), end("lo_key", "lo_seq"), F.lit(" .. "), end("hi_key", "hi_seq"), F.lit("]"))
    return files.select("level", text.alias("line"))
