"""Far too many small files: consolidation by an adaptive REBALANCE.

The small live files are known from the manifest log. Their rows are shuffled under a ``rebalance``
hint; from the sizes of the map outputs Spark then merges and splits the output partitions near the
target and writes one file from each. The result is read back and compared with the source by a
multiset checksum, and only an equal result is committed, by one exclusive creation of its record.

Every attempt writes to a folder of its own, and the commit names the folder that counts, so that an
attempt that is repeated, late or lost never touches what was committed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.order import positions
from tidemark.session import settings
from tidemark.storage import Files, scratch

TARGET_BYTES = 2 * 1024 * 1024
SMALL_BYTES = 524_288

#: The list of small files is broadcast up to this size, at ``BYTES_A_FILE`` each; a longer one is joined by shuffle.
BROADCAST_BYTES = 64 * 1024 * 1024
BYTES_A_FILE = 64

#: Bytes of shuffled rows that become one byte of Parquet; measured on op-log rows (README).
SHUFFLED_PER_STORED = 1.75


def live_files(edits: DataFrame) -> DataFrame:
    """Live files by level: level, file_number, size (null when unknown).

    For each file and level the edit of greatest number decides, and the file is live there when that
    edit is an add. Kinds are compared without case and outer blanks. Repeated rows change nothing; of
    edits with one number an add counts before a delete, and a greater size before a lesser one. Edits
    without file or number are no edits of a file; a null level is a level of its own.
    """
    e = edits.where(F.col("file_number").isNotNull() & F.col("edit_no").isNotNull())
    kind = F.lower(F.trim("kind"))
    e = e.where(kind.isin("add", "delete"))
    last = F.max(F.struct(F.col("edit_no"), (kind == "add").alias("added"), F.col("size"))).alias("_last")
    return e.groupBy("level", "file_number").agg(last).where("_last.added").select("level", "file_number", F.col("_last.size").alias("size"))


def small_files(edits: DataFrame, limit: int = SMALL_BYTES) -> DataFrame:
    """Each live file with a known size below ``limit``, once: file_number and its least known size."""
    return live_files(edits).where(F.col("size") < limit).groupBy("file_number").agg(F.min("size").alias("size"))


def row_hash(columns: list[str]) -> Column:
    """Hash of a row; nulls are told from empty values."""
    return F.xxhash64(*[x for c in sorted(columns) for x in (F.col(c).isNull(), F.col(c))])


#: Sums by which multisets of rows are compared: number of rows, three 20-bit parts of the hashes, and their exclusive-or.
_SUMS = ["n_rows", "h1", "h2", "h3", "hx"]


def _sums(h: Column) -> list[Column]:
    part = lambda n: F.sum(F.shiftrightunsigned(h, n).bitwiseAND(F.lit(0xFFFFF)))
    return [c.alias(name) for c, name in zip((F.count(F.lit(1)), part(44), part(24), part(4), F.bit_xor(h)), _SUMS)]


def _total(parts: DataFrame) -> tuple[int, ...]:
    r = parts.agg(*[F.bit_xor(c) if c == "hx" else F.sum(c) for c in _SUMS]).first()
    return tuple(int(x or 0) for x in r)


def multiset_checksum(df: DataFrame, columns: list[str] | None = None) -> tuple[int, ...]:
    """Number of rows, sums of three 20-bit parts of the rows' hashes, and the exclusive-or of the hashes.

    Depends on the rows and how often each occurs, not on their order or files. The parts keep the sums
    within 64 bits up to 2**43 rows.
    """
    hashed = df.select(row_hash(columns or df.columns).alias("h"))
    return tuple(int(x or 0) for x in hashed.agg(*_sums(F.col("h"))).first())


def rebalanced_write(rows: DataFrame, path: str, target_bytes: int = TARGET_BYTES, shuffled_per_stored: float = SHUFFLED_PER_STORED, by: list[str] | None = None) -> None:
    """Write ``rows`` as Parquet files near ``target_bytes``, by what the shuffle turns out to hold.

    ``by``: columns whose equal rows should meet in few files.
    """
    with settings(
        rows.sparkSession,
        spark__sql__adaptive__enabled="true",
        spark__sql__adaptive__coalescePartitions__parallelismFirst="false",
        spark__sql__adaptive__optimizeSkewsInRebalancePartitions__enabled="true",
        spark__sql__adaptive__advisoryPartitionSizeInBytes=str(int(target_bytes * shuffled_per_stored)),
    ):
        rows.hint("rebalance", *[F.col(c) for c in by or []]).write.mode("overwrite").parquet(path)


@dataclass(frozen=True)
class Consolidation:
    """A committed consolidation. Everything is read from the folder that the commit names."""

    path: str
    attempt: str
    checksum: tuple

    @staticmethod
    def open(spark: SparkSession, path: str) -> Consolidation | None:
        files = Files(spark, path)
        if not files.exists("COMMIT.json"):
            return None
        commit = json.loads(files.read("COMMIT.json"))
        return Consolidation(path, commit["attempt"], tuple(commit["checksum"]))

    def _read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{self.attempt}/{name}")

    def rows(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "data")

    def replaced(self, spark: SparkSession) -> DataFrame:
        """The files whose rows the new ones hold: file_number, size, and n_rows as found in the new files."""
        return self._read(spark, "replaced")

    def files(self, spark: SparkSession) -> DataFrame:
        """The new files that hold rows: name, size, n_rows."""
        return self._read(spark, "pieces").groupBy("name", "size").agg(F.sum("n_rows").alias("n_rows"))

    def edits(self, spark: SparkSession, edits: DataFrame, level: int = 0) -> DataFrame:
        """The change of the manifest log: kind, level, file_number, size, edit_no, name (of new files).

        Every replaced file is deleted on each level it lives on, and the new files are added to ``level``
        under numbers above all that ``edits`` knows.
        """
        gone = self.replaced(spark).select(F.col("file_number").alias("_gone"))
        old = live_files(edits).join(gone, F.col("file_number") == F.col("_gone"), "left_semi")
        last = edits.agg(F.coalesce(F.max("edit_no"), F.lit(0)).alias("e"), F.coalesce(F.max("file_number"), F.lit(0)).alias("f")).first()
        deletes = old.select(F.lit("delete").alias("kind"), "level", "file_number", F.lit(None).cast("long").alias("size"), F.lit(last.e + 1).cast("long").alias("edit_no"), F.lit(None).cast("string").alias("name"))
        new = positions(self.files(spark), [F.col("name")], "_n")
        adds = new.select(F.lit("add").alias("kind"), F.lit(level).cast(edits.schema["level"].dataType).alias("level"), (F.col("_n") + last.f).alias("file_number"), "size", F.lit(last.e + 1).cast("long").alias("edit_no"), "name")
        return deletes.unionByName(adds)


def consolidate(
    rows: DataFrame, edits: DataFrame, *, path: str | None = None, limit: int = SMALL_BYTES, target_bytes: int = TARGET_BYTES, broadcast_bytes: int = BROADCAST_BYTES
) -> Consolidation:
    """Rewrite the rows of all small live files into files near ``target_bytes``.

    ``rows`` has ``file_number``; rows of other files, or of none, stay where they are. Every row of a
    small file is kept as often as it is stored, with all its columns. A small file without rows is
    replaced by nothing. A commit either happens as a whole or not at all; without it readers see the
    old files. Raises when the written rows differ from the source. A path that is committed already is
    returned as it is; of attempts at once on one path, the first to commit counts.

    The source is read a second time for its checksum: one taken while the rows are written would be
    counted twice where an executor is lost, and would not see what that pass misread.
    """
    spark = rows.sparkSession
    path = (path or scratch(spark, "consolidated")).rstrip("/")
    if done := Consolidation.open(spark, path):
        return done
    files, attempt = Files(spark, path), f"attempt-{uuid.uuid4().hex}"
    at = f"{path}/{attempt}"
    small_files(edits, limit).write.parquet(f"{at}/small")
    small = spark.read.schema("file_number long, size long").parquet(f"{at}/small")
    fits = small.count() * BYTES_A_FILE <= broadcast_bytes
    listed = small.select(F.col("file_number").alias("_small_file"))
    source = rows.join(listed.hint("broadcast" if fits else "merge"), rows["file_number"] == F.col("_small_file"), "left_semi")
    rebalanced_write(source, f"{at}/data", target_bytes, by=["file_number"])
    before = multiset_checksum(source)
    data = spark.read.schema(rows.schema).parquet(f"{at}/data")
    hashed = data.select("file_number", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"), F.col("_metadata.file_size").alias("size"), row_hash(rows.columns).alias("_h"))
    hashed.groupBy("file_number", "name", "size").agg(*_sums(F.col("_h"))).write.parquet(f"{at}/pieces")
    pieces = spark.read.parquet(f"{at}/pieces")
    after = _total(pieces)
    if before != after:
        files.delete(attempt)
        raise RuntimeError(f"rows differ after consolidation: {before} and {after}")
    found = pieces.groupBy(F.col("file_number").alias("_f")).agg(F.sum("n_rows").alias("n_rows"))
    replaced = small.join(found, F.col("file_number") == F.col("_f"), "left").select("file_number", "size", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
    replaced.write.parquet(f"{at}/replaced")
    try:
        files.write("COMMIT.json", json.dumps({"attempt": attempt, "checksum": list(after)}), overwrite=False)
    except FileExistsError:
        files.delete(attempt)
    return Consolidation.open(spark, path)
