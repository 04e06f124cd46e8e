"""A durable, ordered key-value store on sorted Parquet files in levels.

Writers queue; the first leads and commits a group of batches as one record of the log, which is a file of
its own, then into the driver's buffer. Bulk writes (``append``) are logged by the executors, many files at
once, and stay there until a flush. A flush turns buffer and bulk logs into a sorted segment.

The set of files is a version: a checkpoint and the edits after it, files of one numbered sequence. A change is
an edit, and it happens when its file appears, whole, under the next number; every ``CHECKPOINT`` numbers
the file holds the whole version, and ``CURRENT`` names it as the place to start reading. Files that a
version no longer lists stay as long as a snapshot reads them, and for ``retain_seconds`` besides, so that a
frame that was handed out earlier can still be read. One store is open on a path at a time.

Layout: ``CURRENT``, ``LOCK``, ``manifest/N.json``, ``wal/wal-N*``, ``segments/N/**.parquet``.

Bulk loads and compactions are Spark jobs over all rows; single puts and gets are for small use. A segment
may hold many Parquet files of following ranges; the manifest has the range of each. Rows of one key may
lie in several files, so that a key of any size is written by many tasks.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from bisect import bisect_left, insort
from collections.abc import Iterable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import compaction, reads, writes
from tidemark.operators.cursor import Cursor
from tidemark.operators.versions import EXPANDED_FILES, GRANDPARENT_FILES, L0_TRIGGER, MAX_FLUSH_LEVEL, MIB
from tidemark.schema import DELETE, LEVELS, OPLOG, PUT
from tidemark.sources import connectors, formats
from tidemark.storage import Files, written

#: Level-0 files from which a write waits a little, and from which it waits for a compaction.
SLOW_AT, STOP_AT = 8, 12
SLOW_SECONDS = 0.001
#: Manifest files from one checkpoint to the next.
CHECKPOINT = 64
#: Keys at which the files of one compaction are cut for the sake of the level below, at most; with more, every n-th is used.
MOST_CUTS = 4096


class StoreError(RuntimeError):
    """The store cannot do this; ``args[0]`` says why."""


class Locked(StoreError):
    """Another store is open on the path."""


class Corrupt(StoreError):
    """Files that the manifest lists are missing or unreadable."""


@dataclass
class Options:
    """``max_buffer_bytes``: the buffer is flushed beyond it. ``max_file_bytes``: size aimed at for one file.

    ``sync`` commits, caches and the like have no counterpart: a write is durable when its log file is there.
    """

    create_if_missing: bool = False
    error_if_exists: bool = False
    max_buffer_bytes: int = 4 * MIB
    max_file_bytes: int = 2 * MIB
    auto_compact: bool = True
    #: Flushes and compactions that writes cause run in a thread beside the writers.
    background: bool = False
    #: How long files are kept that no version in use lists any more.
    retain_seconds: float = 3600.0
    #: Point reads that a file may cost in vain before it is compacted: one for each so many bytes, and so many at least.
    seek_bytes: int = 16 << 10
    least_seeks: int = 100
    #: Bytes that a cursor reads between two rows that are charged like point reads.
    sample_bytes: int = MIB


@dataclass(frozen=True)
class Meta:
    """One Parquet file of a level. ``number`` grows with the age of its rows' arrival."""

    level: int
    number: int
    path: str
    size: int
    rows: int
    lo: bytes
    hi: bytes

    def meets(self, lo: bytes | None, hi: bytes | None) -> bool:
        return (hi is None or self.lo <= hi) and (lo is None or self.hi >= lo)

    def dump(self) -> dict:
        return {**self.__dict__, "lo": self.lo.hex(), "hi": self.hi.hex()}

    @staticmethod
    def load(d: dict) -> Meta:
        return Meta(**{**d, "lo": bytes.fromhex(d["lo"]), "hi": bytes.fromhex(d["hi"])})


@dataclass(frozen=True)
class Edit:
    """A change of the version. Numbers that are None stay; ``compacted`` is added to the totals of its level."""

    added: tuple[Meta, ...] = ()
    deleted: frozenset[tuple[int, int]] = frozenset()
    last_seq: int | None = None
    next_file: int | None = None
    first_log: int | None = None
    pointer: tuple[int, bytes] | None = None
    compacted: tuple[int, float, int, int] | None = None  # level, seconds, bytes read, bytes written

    def dump(self) -> dict:
        pointer = [self.pointer[0], self.pointer[1].hex()] if self.pointer else None
        return {**self.__dict__, "added": [m.dump() for m in self.added], "deleted": sorted(self.deleted), "pointer": pointer}

    @staticmethod
    def load(d: dict) -> Edit:
        pointer = (d["pointer"][0], bytes.fromhex(d["pointer"][1])) if d["pointer"] else None
        return Edit(**{**d, "added": tuple(map(Meta.load, d["added"])), "deleted": frozenset(map(tuple, d["deleted"])), "pointer": pointer, "compacted": tuple(d["compacted"]) if d["compacted"] else None})


@dataclass(frozen=True)
class Version:
    number: int = 0
    last_seq: int = 0
    next_file: int = 1
    first_log: int = 1
    files: tuple[Meta, ...] = ()
    pointers: dict[int, bytes] = field(default_factory=dict)
    #: For each level the seconds and bytes of the compactions into it.
    totals: dict[int, tuple[float, int, int]] = field(default_factory=dict)

    def after(self, e: Edit) -> Version:
        given = {k: v for k in ("last_seq", "next_file", "first_log") if (v := getattr(e, k)) is not None}
        files = tuple(m for m in self.files if (m.level, m.number) not in e.deleted) + e.added
        totals = self.totals
        if e.compacted:
            level, *done = e.compacted
            totals = {**totals, level: tuple(a + b for a, b in zip(totals.get(level, (0.0, 0, 0)), done))}
        return replace(self, number=self.number + 1, files=files, pointers={**self.pointers, **dict([e.pointer] if e.pointer else [])}, totals=totals, **given)

    def dump(self) -> dict:
        return {**self.__dict__, "files": [m.dump() for m in self.files], "pointers": {str(k): v.hex() for k, v in self.pointers.items()}}

    @staticmethod
    def load(d: dict) -> Version:
        pointers = {int(k): bytes.fromhex(v) for k, v in d["pointers"].items()}
        return Version(**{**d, "files": tuple(map(Meta.load, d["files"])), "pointers": pointers, "totals": {int(k): tuple(v) for k, v in d["totals"].items()}})

    def level(self, n: int) -> list[Meta]:
        return sorted((m for m in self.files if m.level == n), key=lambda m: (m.lo, m.number))


@dataclass(frozen=True)
class Snapshot:
    seq: int
    handle: int


class Batch:
    """Operations applied together, in order."""

    def __init__(self):
        self.operations: list[tuple[int, bytes, bytes | None]] = []

    def put(self, key: bytes, value: bytes) -> Batch:
        self.operations.append((PUT, bytes(key), bytes(value)))
        return self

    def delete(self, key: bytes) -> Batch:
        self.operations.append((DELETE, bytes(key), None))
        return self

    def append(self, other: Batch) -> Batch:
        self.operations += other.operations
        return self

    def clear(self) -> None:
        self.operations.clear()

    def size(self) -> int:
        return sum(writes.ELEMENT_BYTES + len(k) + len(v or b"") for _, k, v in self.operations)

    def __len__(self) -> int:
        return len(self.operations)


@dataclass
class _Writer:
    batch: Batch
    done: bool = False
    last: int = 0
    error: Exception | None = None


class _Buffer:
    """Operations of the newest logs, in internal order: key, -seq, op, value."""

    def __init__(self):
        self.rows: list[tuple[bytes, int, int, bytes | None]] = []
        self.size = 0

    def add(self, start: int, operations: Iterable) -> None:
        for i, (op, key, value) in enumerate(operations):
            insort(self.rows, (key, -(start + i), op, value), key=lambda r: r[:2])
            self.size += writes.ELEMENT_BYTES + len(key) + len(value or b"")

    def get(self, key: bytes, seq: int) -> tuple[int, bytes | None] | None:
        """(op, value) of the newest operation on the key up to ``seq``."""
        i = bisect_left(self.rows, (key, -seq), key=lambda r: r[:2])
        return self.rows[i][2:] if i < len(self.rows) and self.rows[i][0] == key else None


class Store:
    def __init__(self, spark: SparkSession, path: str, options: Options | None = None):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options or Options()
        self.files = Files(spark, self.path)
        existed = self.files.exists("CURRENT")
        if existed and self.options.error_if_exists:
            raise StoreError(f"{path} exists")
        if not existed and not self.options.create_if_missing:
            raise StoreError(f"{path} does not exist")
        self._lock()
        try:
            self.failed: Exception | None = None
            self._mutex = threading.RLock()  # version, buffers, snapshots; held for moments only
            self._maintenance = threading.RLock()  # flushes and compactions, one at a time; taken before the other
            self._queued = threading.Condition()
            self._queue: list[_Writer] = []
            self._worker = ThreadPoolExecutor(1, "tidemark-store") if self.options.background else None
            self._scheduled: Future | None = None
            self._snapshots: list[Snapshot] = []
            self._handles = 0
            self._pins: dict[int, list[tuple[Version, list]]] = {}  # snapshot: versions and bulk logs that it reads
            self._retired: dict[str, float] = {}  # file that no version lists: since when
            self._writing: set[str] = set()  # folders of segments in the making
            self._seeks: dict[int, int] = {}  # file number: point reads left
            self._buffer, self._frozen = _Buffer(), None  # the latter is being flushed
            self._bulk: list[tuple[int, list[str]]] = []  # bulk logs: number and files
            self.version = self._open_version() if existed else self._checkpoint(Version())
            self._next_log = self.version.first_log
            self._check_files()
            self._recover()
        except Exception:
            self._unlock()
            raise

    # --- opening and closing

    def _lock(self) -> None:
        self._token = uuid.uuid4().hex
        self.files.mkdirs()
        try:
            self.files.write("LOCK", self._token, overwrite=False)
        except FileExistsError:
            raise Locked(f"{self.path} is in use; a store that died is freed with Store.break_lock") from None

    def _owns(self) -> bool:
        return self.files.exists("LOCK") and self.files.read("LOCK") == self._token

    def _own(self) -> None:
        """Raises when somebody has broken this store's lock, and keeps it from writing ever after."""
        if not self._owns():
            self.failed = Locked(f"the lock of {self.path} was broken")
            raise self.failed

    def _unlock(self) -> None:
        """Free the lock, if it is still this store's."""
        if self._owns():
            self.files.delete("LOCK")

    @staticmethod
    def break_lock(spark: SparkSession, path: str) -> None:
        """Free a path whose store died. The caller must know that it did."""
        Files(spark, path).delete("LOCK")

    @staticmethod
    def destroy(spark: SparkSession, path: str) -> None:
        """Delete a store; one in use cannot be."""
        files = Files(spark, path)
        if files.exists("LOCK"):
            raise Locked(f"{path} is in use")
        files.delete()

    def close(self) -> None:
        """Wait for work in the background, then free the path. What is in the log is found again by the next store."""
        if self._worker:
            self._worker.shutdown(wait=True)
        self._unlock()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def _check_files(self) -> None:
        missing = [m.path for m in self.version.files if not self.files.exists(m.path)]
        if missing:
            raise Corrupt(f"files of the manifest are missing: {missing[:3]}")

    def _recover(self) -> None:
        """Replay the logs not yet flushed, in order of their numbers; damaged records are left out.

        Bulk logs stay files, as they were; those whose commit is missing were never written in full.
        """
        last = self.version.last_seq
        for name, _ in self.files.list("wal"):
            number = int(name[4:16])
            if number < self.version.first_log:
                continue
            self._next_log = max(self._next_log, number + 1)
            if name.endswith(".commit"):
                commit = json.loads(self.files.read(f"wal/{name}"))
                self._bulk.append((number, commit["files"]))
                last = max(last, commit["last_seq"])
            elif name == _log_name(number):
                for record in formats.decode_log(self.files.read_bytes(f"wal/{name}")):
                    start, operations = formats.decode_batch(record)
                    self._buffer.add(start, operations)
                    last = max(last, start + len(operations) - 1)
        self.version = replace(self.version, last_seq=last)

    # --- versions

    def _open_version(self) -> Version:
        """The checkpoint that ``CURRENT`` names, and everything entered after it."""
        number = int(self.files.read("CURRENT").strip())
        version = Version.load(json.loads(self.files.read(_manifest_name(number)))["version"])
        while self.files.exists(_manifest_name(version.number + 1)):
            entry = json.loads(self.files.read(_manifest_name(version.number + 1)))
            version = Version.load(entry["version"]) if "version" in entry else version.after(Edit.load(entry["edit"]))
        return version

    def _checkpoint(self, version: Version) -> Version:
        self.files.mkdirs("manifest")
        self.files.write(_manifest_name(version.number), json.dumps({"version": version.dump()}), overwrite=False)
        self.files.publish("CURRENT", str(version.number))
        return version

    def _commit(self, edit: Edit) -> None:
        """Log the edit and install the version after it."""
        with self._mutex:
            self._own()
            new = self.version.after(edit)
            try:
                if new.number % CHECKPOINT == 0:
                    self._checkpoint(new)
                else:
                    self.files.write(_manifest_name(new.number), json.dumps({"edit": edit.dump()}), overwrite=False)
            except Exception as e:
                self.failed = e
                raise StoreError("the manifest could not be written") from e
            kept = {m.path for m in new.files}
            for m in self.version.files:
                if m.path not in kept:
                    self._retired.setdefault(m.path, time.time())
            self.version = new

    def _writable(self) -> None:
        if self.failed:
            raise StoreError(f"an earlier failure left the store read-only: {self.failed}")

    # --- writing

    def put(self, key: bytes, value: bytes) -> int:
        return self.apply(Batch().put(key, value))

    def delete(self, key: bytes) -> int:
        return self.apply(Batch().delete(key))

    def apply(self, batch: Batch) -> int:
        """Apply a batch at once; returns the sequence number of its last operation. An empty one does nothing.

        Writers of several threads queue. The first commits its batch and those that wait behind it, up to
        the limits of a group, as one record; the others return when it has.
        """
        self._writable()
        if not len(batch):
            return self.version.last_seq
        w = _Writer(batch)
        with self._queued:
            self._queue.append(w)
        return self._await(w)

    def apply_all(self, batches: Iterable[Batch]) -> int:
        """Apply batches in order, each at once, as writers that queue together; returns the last sequence number.

        So many are queued at a time as fit one group at most, and groups are committed as one record.
        """
        self._writable()
        waiting, size = [], 0
        for batch in batches:
            if len(batch):
                waiting.append(_Writer(batch))
                size += batch.size()
            if size >= writes.MAX_GROUP_BYTES:
                self._apply_queued(waiting)
                waiting, size = [], 0
        self._apply_queued(waiting)
        return self.version.last_seq

    def _apply_queued(self, waiting: list[_Writer]) -> None:
        with self._queued:
            self._queue += waiting
        for w in waiting:
            self._await(w)

    def _await(self, w: _Writer) -> int:
        """Return when the writer is done; commit the group at the head of the queue when it leads."""
        with self._queued:
            self._queued.wait_for(lambda: w.done or self._queue[0] is w)
            group = [] if w.done else self._group()
        if group:
            try:
                self._make_room()
                self._commit_group(group)
            except Exception as e:
                for x in group:
                    x.error = e
            with self._queued:
                del self._queue[: len(group)]
                for x in group:
                    x.done = True
                self._queued.notify_all()
        if w.error:
            raise w.error
        return w.last

    def _group(self) -> list[_Writer]:
        """The head of the queue, as far as it is committed together: see ``writes.group_commit``."""
        lead = self._queue[0].batch.size()
        cap = lead + writes.SMALL_WRITE_BYTES if lead <= writes.SMALL_WRITE_BYTES else writes.MAX_GROUP_BYTES
        size, n = lead, 1
        for w in self._queue[1:]:
            size += w.batch.size()
            if size > cap:
                break
            n += 1
        return self._queue[:n]

    def _make_room(self) -> None:
        """Before a write: flush a full buffer, and hold writers back while level 0 has too many files."""
        if self._buffer.size > self.options.max_buffer_bytes:
            if not self._worker:
                self.flush()
            elif self._frozen is not None:
                self._wait()  # the buffer before is still being flushed
            self._schedule()
        n = self.n_files(0)
        if n >= STOP_AT and self.options.auto_compact:
            self._schedule()
            self._wait()
        elif n >= SLOW_AT:
            time.sleep(SLOW_SECONDS)
        self._writable()

    def _schedule(self) -> None:
        """Let full buffers be flushed and levels compacted: by the worker, or now."""
        if not self._worker:
            self._work()
            return
        with self._mutex:
            if self._scheduled is None or self._scheduled.done():
                self._scheduled = self._worker.submit(self._work)

    def _wait(self) -> None:
        if self._scheduled:
            self._scheduled.result()

    def _work(self) -> None:
        if self._buffer.size > self.options.max_buffer_bytes:
            self.flush()
        if self.options.auto_compact:
            self.maintain()

    def _commit_group(self, group: list[_Writer]) -> None:
        operations = [o for w in group for o in w.batch.operations]
        with self._mutex:
            self._own()
            start = self.version.last_seq + 1
            try:
                self.files.mkdirs("wal")
                self.files.write_bytes(f"wal/{_log_name(self._next_log)}", formats.encode_log([formats.encode_batch(start, operations)]), overwrite=False)
            except Exception as e:
                self.failed = e
                raise StoreError("the log could not be written") from e
            self._next_log += 1
            self._buffer.add(start, operations)
            self.version = replace(self.version, last_seq=start + len(operations) - 1)
        last = start - 1
        for w in group:
            last += len(w.batch)
            w.last = last

    def _numbered(self, operations: DataFrame, order: list) -> tuple[DataFrame, int | None]:
        rows = operations.select(F.col("user_key").cast("binary").alias("user_key"), F.col("op").cast("byte").alias("op"), F.col("value").cast("binary").alias("value"), *[o.alias(f"_o{i}") for i, o in enumerate(order)])
        numbered = writes.assign_sequence(rows, [F.col(f"_o{i}") for i in range(len(order))], self.version.last_seq)
        numbered = written(numbered.select("user_key", "seq", "op", "value"), "bulk")
        return numbered, numbered.agg(F.max("seq")).first()[0]

    def append(self, operations: DataFrame, *, order: list, files: int = 8) -> int:
        """Bulk write through the log: a frame of user_key, op, value, numbered in ``order``, at once.

        The executors write the logs, and one file that lists them commits. Returns the last sequence number.
        Rows are read from the logs until a flush.
        """
        self._writable()
        with self._maintenance, self._mutex:
            numbered, last = self._numbered(operations, order)
            if last is None:
                return self.version.last_seq
            self._own()
            number = self._next_log
            self._next_log += 1
            try:
                made = connectors.write_logs(numbered, f"{self.path}/wal", files=files, prefix=f"wal-{number:012d}-").collect()  # one row a log
                names = sorted(r.name for r in made)
                self.files.write(f"wal/wal-{number:012d}.commit", json.dumps({"files": names, "last_seq": last}), overwrite=False)
            except Exception as e:
                self.failed = e
                raise StoreError("the log could not be written") from e
            self._bulk.append((number, names))
            self.version = replace(self.version, last_seq=last)
            return last

    def load(self, operations: DataFrame, *, order: list, level: int = 0) -> int:
        """Bulk load: a frame of user_key, op, value is numbered in ``order`` and becomes one segment at once.

        Returns the last sequence number. Rows go straight to files; the buffer is flushed before.
        """
        self._writable()
        with self._maintenance:
            self.flush()
            numbered, last = self._numbered(operations, order)
            if last is None:
                return self.version.last_seq
            metas = self._write_segment(numbered, level)
            self._commit(Edit(added=tuple(metas), last_seq=last))
            return last

    def _take_numbers(self, n: int) -> int:
        """The first of ``n`` file numbers that nothing else gets."""
        with self._mutex:
            first = self.version.next_file
            self.version = replace(self.version, next_file=first + n)
            return first

    def _write_segment(self, rows: DataFrame, level: int, cuts: list[bytes] | None = None) -> list[Meta]:
        """Write rows sorted, in files of following ranges; returns their metadata.

        Ranges are cut by key and, within a key of many rows, by sequence number. ``cuts``: keys after which
        a file ends in any case. A segment that fails leaves nothing behind.
        """
        folder = f"segments/{uuid.uuid4().hex}"
        self._writing.add(folder)
        try:
            size = rows.agg(F.coalesce(F.sum(writes.element_size()), F.lit(0)), F.count(F.lit(1))).first()
            n = max(1, -(-int(size[0]) // self.options.max_file_bytes))
            order = [F.col("user_key"), F.desc("seq")]
            if cuts:
                rows = rows.withColumn("_cut", F.size(F.filter(F.array(*[F.lit(bytearray(c)) for c in cuts]), lambda c: c < F.col("user_key"))))
                order = [F.col("_cut"), *order]
            out = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).write
            out = out.option("parquet.bloom.filter.enabled#user_key", "true").option("parquet.bloom.filter.expected.ndv#user_key", str(max(1, int(size[1]) // n)))
            (out.partitionBy("_cut") if cuts else out).parquet(f"{self.path}/{folder}")
            back = self.spark.read.schema(OPLOG).option("recursiveFileLookup", "true").parquet(f"{self.path}/{folder}")
            name = F.substring_index(F.col("_metadata.file_path"), f"{folder}/", -1)
            found = back.groupBy(name.alias("name"), F.col("_metadata.file_size").alias("size")).agg(
                F.count(F.lit(1)).alias("rows"), F.min(F.struct("user_key", (-F.col("seq")).alias("s"))).alias("lo"), F.max(F.struct("user_key", (-F.col("seq")).alias("s"))).alias("hi")
            )
            parts = sorted(found.collect(), key=lambda r: (bytes(r.lo.user_key), r.lo.s))  # one row a file
            ends = [(bytes(e.user_key), e.s) for r in parts for e in (r.lo, r.hi)]
            if sum(r["rows"] for r in parts) != size[1] or ends != sorted(ends):
                raise StoreError("a segment does not hold the rows written to it, in their order")
            first = self._take_numbers(len(parts))
            return [Meta(level, first + i, f"{folder}/{r.name}", r.size, r.rows, bytes(r.lo.user_key), bytes(r.hi.user_key)) for i, r in enumerate(parts)]
        except Exception as e:
            self.files.delete(folder)
            self.failed = e
            raise StoreError(f"a segment could not be written: {e}") from e
        finally:
            self._writing.discard(folder)

    def flush(self) -> None:
        """Write buffer and bulk logs to a segment; nothing to do when they are empty."""
        self._writable()
        with self._maintenance:
            with self._mutex:
                if not self._buffer.rows and not self._bulk:
                    return
                self._frozen, self._buffer = self._buffer, _Buffer()
                bulk, first_log = list(self._bulk), self._next_log
            rows = self._rows_of(self._frozen)
            level = 0
            if bulk:
                rows = written(rows.unionByName(self._bulk_frame(bulk)), "flushed")
            else:
                level = self._flush_level(self._frozen.rows[0][0], self._frozen.rows[-1][0])
            metas = self._write_segment(rows, level)
            with self._mutex:
                self._commit(Edit(added=tuple(metas), first_log=first_log, last_seq=self.version.last_seq, next_file=self.version.next_file))
                self._frozen = None
                self._bulk = [b for b in self._bulk if b not in bulk]
            self.remove_obsolete()

    def _flush_level(self, lo: bytes, hi: bytes) -> int:
        v, level = self.version, 0
        met = lambda n: [m for m in v.files if m.level == n and m.meets(lo, hi)]
        if met(0):
            return 0
        while level < MAX_FLUSH_LEVEL and not met(level + 1):
            if sum(m.size for m in met(level + 2)) > GRANDPARENT_FILES * self.options.max_file_bytes:
                break
            level += 1
        return level

    def _rows_of(self, *buffers: _Buffer) -> DataFrame:
        rows = [(bytearray(k), -s, op, None if v is None else bytearray(v)) for b in buffers for k, s, op, v in b.rows]
        return self.spark.createDataFrame(rows, OPLOG)

    def _bulk_frame(self, bulk: list[tuple[int, list[str]]]) -> DataFrame:
        logs = connectors.read_logs(self.spark, [f"{self.path}/wal/{n}" for _, names in bulk for n in names])
        return logs.select("user_key", "seq", F.col("op").cast("byte").alias("op"), "value")

    # --- reading

    def snapshot(self) -> Snapshot:
        with self._mutex:
            self._handles += 1
            s = Snapshot(self.version.last_seq, self._handles)
            self._snapshots.append(s)
            self._pins[s.handle] = []
            return s

    def release(self, snapshot: Snapshot) -> None:
        """Give the snapshot up, and with it the files that frames read at it may still need."""
        with self._mutex:
            self._snapshots.remove(snapshot)
            del self._pins[snapshot.handle]

    def live_snapshots(self) -> list[Snapshot]:
        return sorted(self._snapshots, key=lambda s: (s.seq, s.handle))

    def _seq(self, snapshot: Snapshot | None) -> int:
        if snapshot is None:
            return self.version.last_seq
        if snapshot not in self._snapshots:
            raise StoreError("the snapshot was released")
        return snapshot.seq

    def smallest_snapshot(self) -> int:
        live = self.live_snapshots()
        return live[0].seq if live else self.version.last_seq

    def log(self, lo: bytes | None = None, hi: bytes | None = None, snapshot: Snapshot | None = None) -> DataFrame:
        """Operations stored for keys in [lo, hi], from the buffers, the bulk logs and the files whose range meets it.

        With a snapshot the files stay until it is released, else for ``retain_seconds``.
        """
        with self._mutex:
            version = self.version
            if snapshot:
                pins, reads_now = self._pins[snapshot.handle], (version, list(self._bulk))
                if not pins or pins[-1] != reads_now:
                    pins.append(reads_now)
            rows = self._rows_of(self._buffer, *([self._frozen] if self._frozen else []))
            if self._bulk:
                rows = rows.unionByName(self._bulk_frame(self._bulk))
        paths = [f"{self.path}/{m.path}" for m in version.files if m.meets(lo, hi)]
        if paths:
            rows = rows.unionByName(self.spark.read.schema(OPLOG).parquet(*paths))
        if lo is not None:
            rows = rows.where(F.col("user_key") >= F.lit(bytearray(lo)))
        if hi is not None:
            rows = rows.where(F.col("user_key") <= F.lit(bytearray(hi)))
        return rows

    def get(self, key: bytes, snapshot: Snapshot | None = None) -> bytes | None:
        """Value of the key, None when it is not there or deleted. One in the buffer is found without a job."""
        seq = self._seq(snapshot)
        key = bytes(key)
        with self._mutex:
            found = self._buffer.get(key, seq)
        if found is None:
            row = reads.newest(self.log(key, key), seq).first()
            self._charge(key)
            found = (row.op, row.value) if row is not None else None
        return bytes(found[1]) if found and found[0] == PUT else None

    def multi_get(self, keys: DataFrame, snapshot: Snapshot | None = None, *, key: str = "user_key") -> DataFrame:
        """Each asked key once with ``found``, seq and value; null keys are not asked."""
        return reads.multi_get(self.log(snapshot=snapshot), keys.select(F.col(key).cast("binary").alias(key)), self._seq(snapshot), key=key)

    def _charge(self, key: bytes) -> None:
        """A read that had to ask a second file is charged to the first; a file out of budget is compacted."""
        asked = sorted((m for m in self.version.files if m.meets(key, key)), key=lambda m: (m.level, -m.number))
        if len(asked) < 2 or not self.options.auto_compact or self.failed:
            return
        first = asked[0]
        left = self._seeks.get(first.number, max(self.options.least_seeks, first.size // self.options.seek_bytes)) - 1
        self._seeks[first.number] = left
        if left <= 0 and first.level < LEVELS - 1:
            del self._seeks[first.number]
            self._compact(first.level, [first])

    def scan(self, snapshot: Snapshot | None = None) -> DataFrame:
        return reads.scan(self.log(snapshot=snapshot), self._seq(snapshot)).select("user_key", "value")

    def range(self, lo: bytes | None = None, hi: bytes | None = None, snapshot: Snapshot | None = None) -> DataFrame:
        """Live rows with lo <= key < hi."""
        rows = self.log(lo, hi, snapshot)
        if hi is not None:
            rows = rows.where(F.col("user_key") < F.lit(bytearray(hi)))
        return reads.scan(rows, self._seq(snapshot)).select("user_key", "value")

    def prefix(self, prefix: bytes, snapshot: Snapshot | None = None) -> DataFrame:
        return self.range(prefix, reads.successor(prefix), snapshot)

    def cursor(self, snapshot: Snapshot | None = None, page: int = 1000) -> Cursor:
        """A cursor over the rows as they are now; close it (or use ``with``) to free the files it reads.

        Of what it reads, a row every ``sample_bytes`` is charged like a point read.
        """
        own = None if snapshot else self.snapshot()  # holds rows and files against compaction
        unsampled = 0

        def read(key: bytes, size: int) -> None:
            nonlocal unsampled
            unsampled += size
            if unsampled >= self.options.sample_bytes:
                unsampled = 0
                self._charge(bytes(key))

        def close() -> None:
            if own:
                self.release(own)
            self.remove_obsolete()

        return Cursor(self.scan(snapshot or own), page, close, read)

    # --- maintenance

    def scores(self) -> dict[int, float]:
        v = self.version
        out = {0: float(len(v.level(0)) // L0_TRIGGER)}
        for n in range(1, LEVELS):
            out[n] = sum(m.size for m in v.level(n)) / (10**n * MIB)
        return out

    def maintain(self) -> int:
        """Compact while a level asks for it; returns how many compactions ran."""
        done = 0
        with self._maintenance:
            while True:
                scores = self.scores()
                level = max(range(LEVELS - 1), key=lambda n: (scores[n], -n))
                if scores[level] < 1:
                    return done
                files = self.version.level(level)
                pointer = self.version.pointers.get(level)
                first = next((m for m in files if pointer is None or m.hi > pointer), files[0])
                self._compact(level, [first])
                done += 1

    def compact_range(self, lo: bytes | None = None, hi: bytes | None = None) -> None:
        """Flush, then push everything in [lo, hi] down level by level, to the deepest level that holds some of it."""
        with self._maintenance:
            self.flush()
            deepest = max((m.level for m in self.version.files if m.meets(lo, hi)), default=0)
            for level in range(max(1, deepest)):
                inputs = [m for m in self.version.level(level) if m.meets(lo, hi)]
                if inputs:
                    self._compact(level, inputs)

    def _grow(self, files: list[Meta], inputs: list[Meta]) -> list[Meta]:
        """Inputs with all files of the level that share a key range with them: in level 0 again and again,
        in deeper levels files that meet at a boundary key."""
        while True:
            lo, hi = min(m.lo for m in inputs), max(m.hi for m in inputs)
            more = [m for m in files if m.meets(lo, hi)]
            if len(more) == len(inputs):
                return more
            inputs = more

    def _cuts(self, grand: list[Meta]) -> list[bytes]:
        """Keys after which output files end, so that none meets much more than so many files' worth two levels down."""
        limit, met, cuts = GRANDPARENT_FILES * self.options.max_file_bytes, 0, []
        for m in grand[:-1]:
            met += m.size
            if met > limit:
                cuts.append(m.hi)
                met = 0
        return cuts[:: -(-len(cuts) // MOST_CUTS)] if cuts else []

    def _compact(self, level: int, inputs: list[Meta]) -> None:
        self._writable()
        with self._maintenance:
            self._compact_files(level, inputs)

    def _compact_files(self, level: int, inputs: list[Meta]) -> None:
        v = self.version
        inputs = self._grow(v.level(level), inputs)
        lo, hi = min(m.lo for m in inputs), max(m.hi for m in inputs)
        parents = [m for m in v.level(level + 1) if m.meets(lo, hi)]
        if parents:
            parents = self._grow(v.level(level + 1), parents)
            low, high = min(lo, *(m.lo for m in parents)), max(hi, *(m.hi for m in parents))
            wider = self._grow(v.level(level), [m for m in v.level(level) if m.meets(low, high)])
            total = sum(m.size for m in wider + parents)
            span = min(m.lo for m in wider), max(m.hi for m in wider)
            if len(wider) > len(inputs) and total < EXPANDED_FILES * self.options.max_file_bytes and [m for m in v.level(level + 1) if m.meets(*span)] == parents:
                inputs, (lo, hi) = wider, span
        grand = [m for m in v.level(level + 2) if m.meets(lo, hi)]
        if len(inputs) == 1 and not parents and sum(m.size for m in grand) <= GRANDPARENT_FILES * self.options.max_file_bytes:
            moved = replace(inputs[0], level=level + 1)
            self._commit(Edit(added=(moved,), deleted=frozenset({(level, moved.number)}), pointer=(level, hi)))
            return
        began = time.time()
        paths = [f"{self.path}/{m.path}" for m in inputs + parents]
        rows = self.spark.read.schema(OPLOG).parquet(*paths)
        deeper = [(bytearray(m.lo), bytearray(m.hi)) for m in v.files if m.level > level + 1]
        covered = None
        if deeper:
            ends = T.StructType([T.StructField("lo_key", T.BinaryType()), T.StructField("hi_key", T.BinaryType())])
            deletes = rows.where(F.col("op") == DELETE).select("user_key").distinct()
            held = self.spark.createDataFrame(deeper, ends)
            alone = compaction.deletes_at_base_level(deletes, held)
            covered = deletes.join(alone.withColumnRenamed("user_key", "_alone"), F.col("user_key") == F.col("_alone"), "left_anti")
        try:
            kept = written(compaction.keep(rows, self.smallest_snapshot(), covered=covered), "compacted")
        except Exception as e:
            self.failed = e
            raise StoreError(f"a compaction failed: {e}") from e
        metas = [] if kept.isEmpty() else self._write_segment(kept, level + 1, self._cuts(grand))
        gone = frozenset((m.level, m.number) for m in inputs + parents)
        record = (level + 1, time.time() - began, sum(m.size for m in inputs + parents), sum(m.size for m in metas))
        with self._mutex:
            self._commit(Edit(added=tuple(metas), deleted=gone, pointer=(level, hi), compacted=record, next_file=self.version.next_file))
        self.remove_obsolete()

    def remove_obsolete(self) -> int:
        """Delete what nothing needs: flushed logs, manifests before the checkpoint, and segment files that neither
        the version nor a snapshot lists; files that frames may read after ``retain_seconds``. Returns how many segment files."""
        with self._mutex:
            pinned = [p for pins in self._pins.values() for p in pins]
            live = {m.path for v in (self.version, *(v for v, _ in pinned)) for m in v.files}
            logs = {f"wal/{n}" for _, bulk in pinned for _, names in bulk for n in names}
            start, first_log, now = int(self.files.read("CURRENT").strip()), self.version.first_log, time.time()
            writing = set(self._writing)
        for name, _ in self.files.list("manifest"):
            if name.endswith(".json") and int(name.split(".")[0]) < start:
                self.files.delete(f"manifest/{name}")
        removed, kept = 0, set()
        for path in self.files.walk("segments"):
            folder = "/".join(path.split("/")[:2])
            if path in live or folder in writing:
                kept.add(folder)
            elif path.endswith(".parquet"):
                if self._outlived(path, now):
                    removed += 1
                else:
                    kept.add(folder)
        for name in self.files.folders("segments"):
            if f"segments/{name}" not in kept and f"segments/{name}" not in self._writing:
                self.files.delete(f"segments/{name}")
        for name, _ in self.files.list("wal"):
            if int(name[4:16]) < first_log and f"wal/{name}" not in logs:
                if name == _log_name(int(name[4:16])):  # frames do not read it
                    self.files.delete(f"wal/{name}")
                else:
                    self._outlived(f"wal/{name}", now)
        return removed

    def _outlived(self, path: str, now: float) -> bool:
        """Delete a file that was given up ``retain_seconds`` ago."""
        if now - self._retired.setdefault(path, now) < self.options.retain_seconds:
            return False
        self.files.delete(path)
        self._retired.pop(path)
        return True

    # --- descriptors

    def n_files(self, level: int) -> int:
        if not 0 <= level < LEVELS:
            raise StoreError(f"no level {level}")
        return len(self.version.level(level))

    def statistics(self) -> DataFrame:
        """Files, rows and bytes, and seconds and bytes of the compactions, of each level."""
        rows = []
        for n in range(LEVELS):
            of = self.version.level(n)
            seconds, read, wrote = self.version.totals.get(n, (0.0, 0, 0))
            rows.append((n, len(of), sum(m.rows for m in of), sum(m.size for m in of), float(seconds), read, wrote))
        return self.spark.createDataFrame(rows, "level int, n_files int, n_rows long, n_bytes long, seconds double, bytes_read long, bytes_written long")

    def tables_text(self) -> str:
        lines = []
        for n in range(LEVELS):
            lines.append(f"--- level {n} ---")
            lines += [f"{m.number}:{m.size}[{m.lo!r} .. {m.hi!r}]" for m in self.version.level(n)]
        return "\n".join(lines)


def _log_name(number: int) -> str:
    return f"wal-{number:012d}.log"


def _manifest_name(number: int) -> str:
    return f"manifest/{number:012d}.json"
