"""Many native files at once: logs, table files and manifests as DataFrames, and DataFrames as such files.

Reading takes one file a record of Spark's binary source, so a file is decoded by one task: logs and
table files are bounded by the sizes of the store. Writing encodes one file after the other of a
partition and puts each under a temporary name before its own, so a retried task leaves whole files.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import NEWEST
from tidemark.sources import formats

_ELEMENTS = "file string, start long, ordinal int, seq long, op int, user_key binary, value binary"
_ENTRIES = "file string, user_key binary, seq long, op int, value binary"
_EDITS = "file string, record int, kind string, level int, file_number long, size long, lo_key binary, lo_seq long, hi_key binary, hi_seq long, wal_number long, prev_sequence_number long"
#: Entries of one table file and elements of one log in memory, at most about so many bytes.
FILE_BYTES = 2 << 20


def _decode(spark: SparkSession, path: str | list[str], pattern: str, schema: str, rows: Callable[[str, bytes], Iterator[tuple]]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for name, content in zip(pdf["path"], pdf["content"]):
                yield pd.DataFrame(list(rows(name.rpartition("/")[2], bytes(content))), columns=names).astype(object)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInPandas(decode, schema)


def read_logs(spark: SparkSession, path: str | list[str], pattern: str = "*.log") -> DataFrame:
    """Elements of all batches in all logs below ``path``; records that are no batch are left out."""

    def rows(name: str, content: bytes) -> Iterator[tuple]:
        for record in formats.decode_log(content):
            try:
                start, elements = formats.decode_batch(record)
            except ValueError:
                continue
            for i, (op, key, value) in enumerate(elements):
                yield name, start, i, start + i, op, key, value

    return _decode(spark, path, pattern, _ELEMENTS, rows)


def read_tables(spark: SparkSession, path: str, pattern: str = "*.rdb") -> DataFrame:
    """Entries of all table files below ``path``; a damaged file fails the job."""
    return _decode(spark, path, pattern, _ENTRIES, lambda name, content: ((name, *e) for e in formats.Table(content).entries()))


def lookup_tables(spark: SparkSession, path: str, keys: DataFrame, snapshot: int = NEWEST, *, key: str = "key", pattern: str = "*.rdb", bands: int = 256) -> DataFrame:
    """For each asked binary key that some table file holds up to the snapshot: key, seq, op, value of its newest entry.

    Each file is asked, through its index and filters, for the keys in its range only: keys and files are cut
    at the same keys, which are first keys of files evenly spread over them (one key a file reaches the driver),
    so that no task holds more keys or files than about one part in ``bands`` has.
    """

    def bounds(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for name, content in zip(pdf["path"], pdf["content"]):
                t = formats.Table(bytes(content))
                first, last = next(t.scan(), None), next(t.scan(reverse=True), None)
                if first:
                    yield pd.DataFrame({"path": [name], "content": [bytes(content)], "lo": [first[0]], "hi": [last[0]]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    files = files.mapInPandas(bounds, "path string, content binary, lo binary, hi binary")
    asked = keys.where(F.col(key).isNotNull()).select(F.col(key).cast("binary").alias("key")).distinct()
    firsts = sorted({bytes(r.lo) for r in files.select("lo").collect()})
    splits = firsts[:: -(-len(firsts) // bands) or 1][1:]
    band = lambda c: F.size(F.filter(F.array(*[F.lit(bytearray(x)) for x in splits]), lambda x: x <= F.col(c))) if splits else F.lit(0)
    asked = asked.withColumn("band", band("key"))
    files = files.withColumn("band", F.explode(F.sequence(band("lo"), band("hi"))))

    def ask(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        wanted = sorted(map(bytes, left["key"]))
        rows = []
        for content, lo, hi in zip(right["content"], right["lo"], right["hi"]):
            t = formats.Table(bytes(content))
            for k in wanted[bisect_left(wanted, bytes(lo)) : bisect_right(wanted, bytes(hi))]:
                if found := t.get(k, snapshot):
                    rows.append((k, *found))
        return pd.DataFrame(rows, columns=["key", "seq", "op", "value"])

    found = asked.groupBy("band").cogroup(files.groupBy("band")).applyInPandas(ask, "key binary, seq long, op int, value binary")
    return found.groupBy("key").agg(F.max_by(F.struct("seq", "op", "value"), "seq").alias("_e")).select("key", "_e.*")


def read_manifests(spark: SparkSession, path: str, pattern: str = "*.manifest") -> DataFrame:
    """One row for each scalar set, file deleted and file added, in the order of the records of each file."""

    def rows(name: str, content: bytes) -> Iterator[tuple]:
        for i, record in enumerate(formats.decode_log(content)):
            e = formats.decode_edit(record)
            none = (None,) * 5
            if e.wal_number is not None or e.prev_sequence_number is not None:
                yield (name, i, "scalar", None, None, *none, e.wal_number, e.prev_sequence_number)
            for level, number in e.deleted:
                yield (name, i, "delete", level, number, *none, None, None)
            for level, number, size, lo, hi in e.added:
                yield (name, i, "add", level, number, size, lo[0], lo[1], hi[0], hi[1], None, None)

    return _decode(spark, path, pattern, _EDITS, rows)


def put_file(folder: str, name: str, content: bytes) -> None:
    """Write a file of any file system pyarrow knows, whole or not at all."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
    system.create_dir(root, recursive=True)
    temporary = f"{root}/.{name}.{uuid.uuid4().hex}"
    try:
        with system.open_output_stream(temporary) as out:
            out.write(content)
        system.move(temporary, f"{root}/{name}")
    except Exception:
        if system.get_file_info(temporary).is_file:
            system.delete_file(temporary)
        raise


def write_tables(entries: DataFrame, folder: str, *, file_bytes: int = FILE_BYTES, partitions: int | None = None) -> DataFrame:
    """Entries (user_key binary, seq, op, value binary; distinct by key and seq) as table files of about ``file_bytes``.

    Files hold following ranges, cut by key and, within a key of many entries, by sequence number, so that no
    task holds more than one file. Returns name, number of entries and bytes.
    """
    columns = entries.select(F.col("user_key").cast("binary").alias("user_key"), F.col("seq").cast("long").alias("seq"), F.col("op").cast("int").alias("op"), F.col("value").cast("binary").alias("value"))
    order = [F.col("user_key"), F.desc("seq")]
    parted = columns.repartitionByRange(partitions, *order) if partitions else columns.repartitionByRange(*order)
    token = uuid.uuid4().hex[:8]

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        held, size, done = [], 0, 0
        part = TaskContext.get().partitionId()

        def close() -> pd.DataFrame:
            nonlocal held, size, done
            content = formats.encode_table(held)
            name = f"{token}-{part:06d}-{done:06d}.rdb"
            put_file(folder, name, content)
            out = pd.DataFrame({"name": [name], "n_entries": [len(held)], "n_bytes": [len(content)]})
            held, size, done = [], 0, done + 1
            return out

        for pdf in parts:
            for key, seq, op, value in zip(pdf["user_key"], pdf["seq"], pdf["op"], pdf["value"]):
                key = bytes(key)
                if size >= file_bytes:
                    yield close()
                held.append((key, int(seq), int(op), None if value is None else bytes(value)))
                size += len(key) + 9 + (len(value) if value is not None else 0)
        if held:
            yield close()

    return parted.sortWithinPartitions(*order).mapInPandas(write, "name string, n_entries long, n_bytes long")


def write_logs(elements: DataFrame, folder: str, *, files: int, prefix: str = "wal-") -> DataFrame:
    """Operations (user_key, seq, op, value) as logs: each run of following seqs is a batch, about ``files`` files by ranges of seq.

    Rows must be distinct by seq. Returns name and number of records.
    """
    columns = elements.select(F.col("user_key").cast("binary").alias("user_key"), F.col("seq").cast("long").alias("seq"), F.col("op").cast("int").alias("op"), F.col("value").cast("binary").alias("value"))
    token = uuid.uuid4().hex[:8]

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        records, content, batch, start = 0, bytearray(), [], None
        done = 0

        def end_batch() -> None:
            nonlocal batch, start, records
            if batch:
                content.extend(formats.encode_log([formats.encode_batch(start, batch)], len(content)))
                records += 1
                batch, start = [], None

        def end_file() -> pd.DataFrame:
            nonlocal records, content, done
            name = f"{prefix}{token}-{part:06d}-{done:06d}.log"
            put_file(folder, name, bytes(content))
            out = pd.DataFrame({"name": [name], "n_records": [records]})
            records, content, done = 0, bytearray(), done + 1
            return out

        for pdf in parts:
            for key, seq, op, value in zip(pdf["user_key"], pdf["seq"], pdf["op"], pdf["value"]):
                if batch and (int(seq) != start + len(batch) or len(batch) >= 4096):
                    end_batch()
                    if len(content) >= FILE_BYTES:
                        yield end_file()
                if start is None:
                    start = int(seq)
                batch.append((int(op), bytes(key), None if value is None else bytes(value)))
        end_batch()
        if records:
            yield end_file()

    return columns.repartitionByRange(files, "seq").sortWithinPartitions("seq").mapInPandas(write, "name string, n_records long")


def write_manifests(edits: DataFrame, folder: str, *, files: int) -> DataFrame:
    """Edit rows (as the table ``edits``) as manifest files by ranges of edit_no, one record for each edit_no.

    Sizes and bounds that are unknown are written as zero and the empty key: the format has no null.
    """
    kind = F.lower(F.trim("kind"))
    rows = edits.where(F.col("edit_no").isNotNull() & kind.isin("add", "delete", "scalar")).select(
        "edit_no", kind.alias("kind"), "level", "file_number", F.coalesce("size", F.lit(0)).alias("size"),
        F.coalesce(F.col("lo_key").cast("binary"), F.lit(b"")).alias("lo_key"), F.coalesce("lo_seq", F.lit(0)).alias("lo_seq"),
        F.coalesce(F.col("hi_key").cast("binary"), F.lit(b"")).alias("hi_key"), F.coalesce("hi_seq", F.lit(0)).alias("hi_seq"), "wal_number", "prev_sequence_number",
    ).distinct()
    token = uuid.uuid4().hex[:8]

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        records, edit, number = [], None, None
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                if r.edit_no != number:
                    if edit is not None:
                        records.append(formats.encode_edit(edit))
                    edit, number = formats.Edit(), r.edit_no
                if r.kind == "scalar":
                    edit.wal_number = None if pd.isna(r.wal_number) else int(r.wal_number)
                    edit.prev_sequence_number = None if pd.isna(r.prev_sequence_number) else int(r.prev_sequence_number)
                elif r.kind == "delete":
                    edit.deleted.append((int(r.level), int(r.file_number)))
                else:
                    edit.added.append((int(r.level), int(r.file_number), int(r.size), (bytes(r.lo_key), int(r.lo_seq), 1), (bytes(r.hi_key), int(r.hi_seq), 1)))
        if edit is not None:
            records.append(formats.encode_edit(edit))
            name = f"MANIFEST-{token}-{part:06d}.manifest"
            put_file(folder, name, formats.encode_log(records))
            yield pd.DataFrame({"name": [name], "n_records": [len(records)]})

    return rows.repartitionByRange(files, "edit_no").sortWithinPartitions("edit_no", "kind").mapInPandas(write, "name string, n_records long")
