"""Processing only new or changed records: a ledger of work with pending, leased and done states.

Work arrives in deliveries; an item is known by its sequence number and becomes visible when the first
delivery that carries it arrives. Runs lease the items visible up to a moment (``read_upto``). Because
a lease covers everything up to a moment, the ledger keeps two marks instead of a row for each item:

    done      visible no later than the greatest mark of a run that succeeded
    leased    not done, visible no later than the mark of a run that still holds its lease
    pending   everything else, also what failed, aborted, rolled-back or expired runs had leased

``WorkLedger`` is the durable log behind it. A change is a file of events, which appears whole and under
the next number or not at all; the number of a lease is its fencing token. A writer whose lease expired,
was released or was followed by another lease cannot report done. A run writes to a path made of its range
of marks and its token, so that a retry of the run overwrites what its lost attempt left, and nobody else's
output. Only the event ``done`` makes an output count, and it names the path: whatever a run left that
crashed before it, or a stale writer leaves after, is listed by nobody and deleted with the next lease.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.storage import Files

PENDING, LEASED, DONE = "pending", "leased", "done"


def final_states(runs: DataFrame, *, run: str = "run_id", status: str = "status", mark: str = "read_upto", at: str = "logged_at") -> DataFrame:
    """Each run once, with the status and mark of its latest row; at equal times the greater status counts.

    Rows without run, status or time are left out; repeated rows change nothing.
    """
    seen = runs.where(F.col(run).isNotNull() & F.col(status).isNotNull() & F.col(at).isNotNull())
    last = F.max(F.struct(F.col(at), F.col(status), F.col(mark))).alias("_last")
    return seen.groupBy(F.col(run).alias("run_id")).agg(last).select("run_id", F.col("_last").getField(status).alias("status"), F.col("_last").getField(mark).alias("mark"))


def delivered_items(headers: DataFrame, elements: DataFrame) -> DataFrame:
    """Each sequence number that some delivery carries, with the time from which it was visible.

    A delivery needs a header row with start and arrival; it carries the elements it has, whatever their
    key and operation. Repeated rows of either table change nothing, elements without ordinal carry no
    number, and deliveries without elements carry none.
    """
    h = headers.where(F.col("batch_no").isNotNull() & F.col("starting_seq_number").isNotNull() & F.col("arrived_at").isNotNull())
    h = h.groupBy("batch_no", "starting_seq_number").agg(F.min("arrived_at").alias("_at"))
    e = elements.where(F.col("ordinal").isNotNull()).select(F.col("batch_no").alias("_batch"), F.col("ordinal").cast("long").alias("_ordinal"))
    seq = (F.col("starting_seq_number") + F.col("_ordinal")).alias("seq")
    carried = e.join(h, F.col("_batch") == F.col("batch_no")).select(seq, "_at")
    return carried.groupBy("seq").agg(F.min("_at").alias("visible_at"))


def delivered_operations(headers: DataFrame, elements: DataFrame) -> DataFrame:
    """Each item with the operation it names and when it arrived: seq, visible_at, batch_no, op, user_key, value.

    Of the deliveries that carry an item, the one that arrived first is taken, then the one of least number.
    """
    h = headers.where(F.col("batch_no").isNotNull() & F.col("starting_seq_number").isNotNull() & F.col("arrived_at").isNotNull()).select("batch_no", "starting_seq_number", "arrived_at").distinct()
    e = elements.where(F.col("ordinal").isNotNull()).select(F.col("batch_no").alias("_batch"), F.col("ordinal").cast("long").alias("_ordinal"), "op", "user_key", "value")
    carried = e.join(h, F.col("_batch") == F.col("batch_no"))
    content = F.struct(F.col("arrived_at").alias("visible_at"), "batch_no", "op", "user_key", "value")
    return carried.groupBy((F.col("starting_seq_number") + F.col("_ordinal")).alias("seq")).agg(F.min(content).alias("_c")).select("seq", "_c.*")


def moment(at: Column | str) -> Column:
    """A timestamp as text that compares as the moments do; null for null."""
    return (F.col(at) if isinstance(at, str) else at).cast("string")


def replayed(spark: SparkSession, root: str, runs: DataFrame) -> tuple[WorkLedger, float]:
    """A ledger below ``root`` that holds the leases of ``runs`` and their ends, and the moment after the last of them.

    One row a run reaches the driver. Each run leased, at the time of its latest row, everything up to its
    mark. The log holds no lease times, so a run that is still running is taken to have expired at the moment
    after the log's end. Runs without a mark leased nothing.
    """
    last = runs.groupBy(F.col("run_id").alias("_run")).agg(F.max("logged_at").alias("at"))
    past = final_states(runs).join(last, F.col("run_id") == F.col("_run")).where("mark IS NOT NULL")
    past = past.select("run_id", "status", moment("mark").alias("mark"), F.unix_micros(F.col("at").cast("timestamp")).alias("at")).orderBy("at", "run_id").collect()
    ledger = WorkLedger(spark, root)
    ledger.replay((str(r["run_id"]), r["mark"], r["status"], r["at"] / 1e6) for r in past)
    return ledger, max((r["at"] for r in past), default=0) / 1e6 + 1


def _upto(items: DataFrame, visible: str, mark: str | None) -> Column:
    """Whether an item was visible by the mark; no mark covers nothing."""
    return F.lit(False) if mark is None else F.col(visible) <= F.lit(mark).cast(items.schema[visible].dataType)


def item_states(items: DataFrame, ledger: WorkLedger, now: float, *, visible: str = "visible_at") -> DataFrame:
    """``items`` with the ``state`` that the ledger gives them. An item never visible is no work and is left out."""
    done, leased = ledger.marks(now)
    state = F.when(_upto(items, visible, done), DONE).when(_upto(items, visible, leased), LEASED).otherwise(PENDING)
    return items.where(F.col(visible).isNotNull()).withColumn("state", state)


def process_pending(
    spark: SparkSession, root: str, headers: DataFrame, elements: DataFrame, runs: DataFrame, *, items: Callable[[DataFrame, DataFrame], DataFrame] = delivered_items, seconds: float = 3600.0
) -> DataFrame:
    """The items that the next run has to process, each once, as that run writes them.

    ``runs`` are replayed into a ledger below ``root``; the next run leases everything that has arrived,
    writes the items of its range below the lease's path, and reports done; the rows are read from the
    outputs that done events name. ``items`` makes items with ``visible_at`` of headers and elements. Nothing
    pending: no rows. Repeated calls on one ``root`` find their work done and return the same output.
    """
    ledger, now = replayed(spark, root, runs)
    found = items(headers, elements)
    upto = headers.agg(moment(F.max("arrived_at"))).first()[0]
    lease = ledger.lease("next", upto, now, seconds) if upto else None
    if lease:
        work = lambda after, upto: found.where(~_upto(found, "visible_at", after) & _upto(found, "visible_at", upto))
        ledger.process(lease, work, lambda: now)
    paths = ledger.outputs()
    return spark.read.schema(found.schema).parquet(*paths) if paths else found.where(F.lit(False))


class StaleLease(RuntimeError):
    """The lease of this token no longer holds."""


@dataclass(frozen=True)
class Lease:
    token: int
    owner: str
    after: str | None
    upto: str
    until: float

    @property
    def folder(self) -> str:
        """Output path of this range under this token; equal for every attempt of its holder."""
        return f"out/{_safe(self.after) if self.after is not None else '-'}--{_safe(self.upto)}/token-{self.token:012d}"


def _safe(mark: str) -> str:
    """The mark as a file name; different marks have different names."""
    return "".join(c if c.isalnum() and c.isascii() or c == "." else f"_{ord(c):x}_" for c in mark)


@dataclass(frozen=True)
class _State:
    done: str | None
    lease: dict | None
    outputs: list[str]


class WorkLedger:
    """Durable log of leases below ``root``. Marks are strings that compare as the moments they name.

    ``log/N.json`` holds the event N and those that were entered with it. Every ``CHECKPOINT`` events the
    state so far is entered as an event of its own, and nothing before it is read again.
    """

    CHECKPOINT = 256

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        self.files.mkdirs("log")

    def events(self) -> list[dict]:
        """Events from the last checkpoint on, in order of their numbers.

        A file that cannot be read holds no event, but its number is taken (kind ``torn``).
        """
        out: list[dict] = []
        for name, _ in reversed(self.files.list("log")):
            if not (name.endswith(".json") and name[:-5].isdigit()):
                continue
            number = int(name[:-5])
            try:
                entered = [e | {"number": number + i} for i, e in enumerate(json.loads(self.files.read(f"log/{name}")))]
                kinds = [e["kind"] for e in entered]
            except (ValueError, TypeError, KeyError):
                entered, kinds = [{"kind": "torn", "number": number}], []
            out[:0] = entered
            if "state" in kinds:
                break
        return out

    def _enter(self, events: list[dict], new: list[dict]) -> int:
        """Enter events together under the next number; FileExistsError when another writer has it."""
        number = events[-1]["number"] + 1 if events else 1
        text = json.dumps(new)
        if number // self.CHECKPOINT != (number + len(new)) // self.CHECKPOINT:
            s = self._fold(events + [e | {"number": number + i} for i, e in enumerate(new)])
            text = json.dumps([*new, {"kind": "state", "done": s.done, "lease": s.lease, "outputs": s.outputs}])
        self.files.write(f"log/{number:012d}.json", text, overwrite=False)
        return number

    @staticmethod
    def _fold(events: Iterable[dict]) -> _State:
        """Greatest done mark, the lease that was neither ended nor followed by another, and the committed outputs."""
        s = _State(None, None, [])
        for e in events:
            if e["kind"] == "state":
                s = _State(e["done"], e["lease"], e["outputs"])
            elif e["kind"] == "lease":
                s = _State(s.done, e, s.outputs)
            elif e["kind"] in ("done", "released") and s.lease and e["token"] == s.lease["number"]:
                if e["kind"] == "done":
                    s = _State(max(s.done or "", s.lease["upto"]), None, s.outputs + ([e["path"]] if e.get("path") else []))
                else:
                    s = _State(s.done, None, s.outputs)
        return s

    @staticmethod
    def _held(s: _State, now: float) -> dict | None:
        return s.lease if s.lease and s.lease["until"] > now else None

    def replay(self, runs: Iterable[tuple[str, str, str, float]]) -> None:
        """Enter past runs (owner, mark, last status, time) in order: a lease each, and its end unless it is still running.

        Enters all of them at once, and into an empty ledger only.
        """
        if self.events():
            return
        new: list[dict] = []
        done = None
        for owner, upto, status, at in runs:
            if done is not None and upto <= done:
                continue  # nothing was new to it
            new.append({"kind": "lease", "owner": owner, "after": done, "upto": upto, "until": at})
            if status != "running":
                new.append({"kind": "done" if status == "succeeded" else "released", "token": len(new)})
            done = upto if status == "succeeded" else done
        if new:
            try:
                self._enter([], new)
            except FileExistsError:
                pass  # another driver entered them

    def marks(self, now: float) -> tuple[str | None, str | None]:
        """The mark up to which everything is done, and the one up to which a lease holds."""
        s = self._fold(self.events())
        held = self._held(s, now)
        return s.done, held["upto"] if held else None

    def done_upto(self) -> str | None:
        return self._fold(self.events()).done

    def outputs(self) -> list[str]:
        """Paths of the outputs that count, in the order in which they were reported done."""
        return [f"{self.root}/{p}" for p in self._fold(self.events()).outputs]

    def lease(self, owner: str, upto: str, now: float, seconds: float) -> Lease | None:
        """Lease everything pending up to a mark; None while another lease holds or when nothing is new.

        Two owners that try at once compete for the same number; the loser gets None. What runs before left
        without reporting it done is deleted.
        """
        events = self.events()
        s = self._fold(events)
        if self._held(s, now) or (s.done is not None and upto <= s.done):
            return None
        try:
            number = self._enter(events, [{"kind": "lease", "owner": owner, "after": s.done, "upto": upto, "until": now + seconds}])
        except FileExistsError:
            return None
        for item in self.files.folders("out"):
            for token in self.files.folders(f"out/{item}"):
                if f"out/{item}/{token}" not in s.outputs:
                    self.files.delete(f"out/{item}/{token}")
        return Lease(number, owner, s.done, upto, now + seconds)

    def _close(self, lease: Lease, now: float, event: dict) -> None:
        events = self.events()
        held = self._held(self._fold(events), now)
        if not held or held["number"] != lease.token:
            raise StaleLease(f"token {lease.token} of {lease.owner}")
        try:
            self._enter(events, [event | {"token": lease.token}])
        except FileExistsError:
            raise StaleLease(f"token {lease.token} of {lease.owner}") from None

    def done(self, lease: Lease, now: float, path: str | None = None) -> None:
        self._close(lease, now, {"kind": "done", "path": path})

    def release(self, lease: Lease, now: float) -> None:
        self._close(lease, now, {"kind": "released"})

    def process(self, lease: Lease, work: Callable[[str | None, str], DataFrame], clock: Callable[[], float]) -> str:
        """Write ``work(after, upto)`` to the lease's folder and report it done; on failure the lease is released."""
        try:
            work(lease.after, lease.upto).write.mode("overwrite").parquet(f"{self.root}/{lease.folder}")
        except Exception:
            self.release(lease, clock())
            raise
        self.done(lease, clock(), lease.folder)
        return f"{self.root}/{lease.folder}"
