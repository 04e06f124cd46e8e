"""Has this key been seen before? An exact ledger of keys, hash-bucketed on disk.

History is kept as generations, Parquet tables bucketed and sorted by key with one file a bucket, so that
a batch is shuffled once and joins each generation by sort-merge without moving or sorting history. Within
a batch, the first arrival of each key (rank 1) is found by a map-side combined minimum; it is new when no
generation has the key. The new first arrivals become a generation, and a record was seen before exactly
when it is not one of them. No answer is approximate, hence the rate of wrong answers is zero, and memory
holds no more keys than one task's sort buffer.

The ledger is durable. A numbered manifest, which appears whole or not at all, lists the generations and
the batches they answer; a generation that no manifest lists does not exist. A batch that is asked again,
after a failed job or in another session, gets the answer it got, and a batch that failed before its
manifest was written is asked anew.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import settings
from tidemark.storage import Files, registered, scratch

HISTORY = "history"
#: Generations beyond which they are merged into one.
MOST_GENERATIONS = 8


class KeyLedger:
    """Keys seen so far, below ``path``. ``buckets`` is fixed for the ledger's life: about one per 128 MB of keys."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, most_generations: int = MOST_GENERATIONS):
        self.spark, self.most_generations = spark, most_generations
        self.path = (path or scratch(spark, "ledger")).rstrip("/")
        self.files = Files(spark, self.path)
        self.files.mkdirs("manifest")
        listed = self._manifest()
        self.buckets = listed["buckets"] if listed else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _manifest(self) -> dict | None:
        names = [n for n, _ in self.files.list("manifest") if n.endswith(".json")]
        return json.loads(self.files.read(f"manifest/{names[-1]}")) if names else None

    def _publish(self, old: dict | None, generations: list[str], batches: list[str], key_type: str) -> None:
        """Raises FileExistsError when another writer was faster; what was written for it is then never read."""
        number = old["number"] + 1 if old else 1
        new = {"number": number, "buckets": self.buckets, "key_type": key_type, "generations": generations, "batches": batches}
        self.files.write(f"manifest/{number:012d}.json", json.dumps(new), overwrite=False)

    def _name(self, generation: str) -> str:
        name = f"key_ledger_{uuid.uuid5(uuid.NAMESPACE_URL, f'{self.path}/{generation}').hex}"
        registered.add(name)
        return name

    def _table(self, generation: str, key_type: str) -> DataFrame:
        """A generation as a bucketed table, which every session finds under one name made of its path."""
        name = self._name(generation)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (_key {key_type}, _first BIGINT, _batch STRING) USING parquet "
            f"CLUSTERED BY (_key) SORTED BY (_key) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{generation}'"
        )
        return self.spark.table(name)

    def _write(self, keys: DataFrame) -> str:
        """A new generation: one sorted file a bucket. Nobody reads it before a manifest lists it."""
        generation = f"keys-{uuid.uuid4().hex}"
        out = keys.repartition(self.buckets, "_key").write.bucketBy(self.buckets, "_key").sortBy("_key")
        out.option("path", f"{self.path}/{generation}").saveAsTable(self._name(generation))
        return generation

    def history(self) -> list[DataFrame]:
        """The generations, each with _key, _first and the batch that brought the key."""
        m = self._manifest()
        return [self._table(g, m["key_type"]) for g in m["generations"]] if m else []

    def load(self, keys: DataFrame, key: str) -> None:
        """Start the ledger with earlier keys: null keys left out, each once. Loaded once; loading again changes nothing."""
        firsts = keys.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.lit(None).cast("long").alias("_first"))
        self._record(HISTORY, firsts)

    def _record(self, batch_id: str, firsts: DataFrame) -> None:
        m = self._manifest()
        if m and batch_id in m["batches"]:
            return
        past = m["generations"] if m else []
        key_type = m["key_type"] if m else firsts.schema["_key"].dataType.simpleString()
        new = firsts
        # no more shuffle than the one of the batch: all generations have its buckets
        for g in past:
            known = self._table(g, key_type).select(F.col("_key").alias("_known"))
            # a left join, as an anti-join would be moved below the minimum and meet all records of a hot key
            new = new.join(known.hint("merge"), F.col("_key") == F.col("_known"), "left").where(F.col("_known").isNull()).drop("_known")
        with settings(self.spark, spark__sql__legacy__bucketedTableScan__outputOrdering="true"):
            written = self._write(new.select(F.col("_key").cast(key_type).alias("_key"), F.col("_first").cast("long").alias("_first"), F.lit(batch_id).alias("_batch")))
        self._publish(m, [*past, written], [*(m["batches"] if m else []), batch_id], key_type)
        if len(past) + 1 > self.most_generations:
            self.merge()

    def merge(self) -> None:
        """Merge all generations into one; answers stay as they are."""
        m = self._manifest()
        if m and len(m["generations"]) > 1:
            merged = self._write(reduce(DataFrame.unionByName, [self._table(g, m["key_type"]) for g in m["generations"]]))
            self._publish(m, [merged], m["batches"], m["key_type"])

    def clean(self) -> None:
        """Delete generations that the newest manifest does not list. No other session may be reading or writing."""
        m = self._manifest()
        for g in self.files.folders():
            if g.startswith("keys-") and g not in (m["generations"] if m else []):
                self.files.delete(g)

    def ask(self, batch: DataFrame, key: str, arrival: str, batch_id: str) -> DataFrame:
        """Record the batch's new keys under its id; return the rows of the batch (key, arrival) that are *new*.

        One row for each key that neither history nor an earlier record of the batch has: the
        arrival of its first record. Every other record with a key was seen before. Null keys are
        never new nor seen. Records of equal key and arrival are the same record. Batches must be
        asked in order of arrival; one that was asked already is answered from the ledger as then.
        """
        firsts = batch.where(F.col(key).isNotNull() & F.col(arrival).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(arrival).alias("_first"))
        self._record(batch_id, firsts)
        return self.new_keys([batch_id], key, arrival)

    def new_keys(self, batch_ids: list[str], key: str, arrival: str) -> DataFrame:
        """Keys that these batches brought, with the arrival of the record that did."""
        rows = [g.where(F.col("_batch").isin(batch_ids)).select(F.col("_key").alias(key), F.col("_first").alias(arrival)) for g in self.history()]
        return reduce(DataFrame.unionByName, rows)


def cut_points(batch: DataFrame, arrival: str, batches: int) -> list[int]:
    """Arrivals that cut the range of arrivals into so many equal parts; none for an empty table."""
    lo, hi = batch.agg(F.min(arrival), F.max(arrival)).first()
    return sorted({lo + (hi - lo) * i // batches for i in range(1, batches)}) if lo is not None else []


def seen_before(
    batch: DataFrame, history: DataFrame, *, key: str = "user_key", arrival: str = "probe_id", history_key: str = "user_key", buckets: int | None = None, batches: list | None = None, path: str | None = None
) -> DataFrame:
    """The records (key, arrival; distinct) whose key occurs in ``history`` or in an earlier record.

    ``batches``: ascending upper bounds of arrival that cut the input into batches which are asked one
    after the other; None asks all at once. The result does not depend on them. ``path`` keeps the ledger.

    Nulls: records without key or arrival are not in the result; null history keys are no keys. Empty
    key: a key. Ties: records with equal arrival are not earlier than each other. Empty history or
    batch: allowed. Other columns are not touched.
    """
    ledger = KeyLedger(batch.sparkSession, path, buckets=buckets)
    ledger.load(history, history_key)
    bounds = [None, *(batches or []), None]
    asked = []
    for low, high in zip(bounds, bounds[1:]):
        part = batch
        if low is not None:
            part = part.where(F.col(arrival) > low)
        if high is not None:
            part = part.where(F.col(arrival) <= high)
        asked.append(f"{arrival} {low} to {high}")
        ledger.ask(part, key, arrival, asked[-1])
    records = batch.where(F.col(key).isNotNull() & F.col(arrival).isNotNull()).select(key, arrival)
    first = ledger.new_keys(asked, "_new_key", "_new_arrival")
    # joined by key and arrival together, so that a hot key's records spread over all tasks
    return records.join(first, (F.col(key) == F.col("_new_key")) & (F.col(arrival) == F.col("_new_arrival")), "left_anti").distinct()
