"""The op-log as a stream: micro-batches that are applied once, and a live view kept as state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.changes import apply_patches, compose_again, compose_patches
from tidemark.storage import Files, scratch

STATE = "seq long, op int, value string"
OUT = "user_key string, seq long, op int, value string"


def read_changes(spark: SparkSession, path: str, schema, *, max_files: int = 100, max_bytes: int | None = None) -> DataFrame:
    """Files of changes as a stream; ``max_files``, or ``max_bytes``, bounds what one micro-batch takes. ``path``: a folder or one file.

    A micro-batch is committed as a whole, like a group of writers; while it runs, what arrives waits.
    """
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", max_files) if max_bytes is None else reader.option("maxBytesPerTrigger", max_bytes)
    files = Files(spark, path)
    if files.fs.getFileStatus(files.path("")).isFile():
        path, _, name = path.rpartition("/")
        reader = reader.option("pathGlobFilter", name)
    return reader.parquet(path)


def newest_by_key(changes: DataFrame) -> DataFrame:
    """Stream of user_key, seq, op, value: each key's newest operation whenever a newer one came.

    State keeps deletes too: without them an older put that comes late would revive its key. Late,
    repeated and out-of-order operations change nothing, so no watermark is needed and none is lost.
    Micro-batches are first reduced by Spark's group shuffle; state holds one row a key.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, op, value = state.get if state.exists else (-1, 0, None)
        moved = False
        for pdf in parts:
            pdf = pdf[pdf["op"].isin([0, 1]) & pdf["seq"].notna()]
            if len(pdf):
                last = pdf.loc[pdf["seq"].idxmax()]
                if int(last["seq"]) > seq:
                    seq, op, value, moved = int(last["seq"]), int(last["op"]), last["value"], True
        if moved:
            value = None if op == 0 else value
            state.update((seq, op, value))
            yield pd.DataFrame({"user_key": [key[0]], "seq": [seq], "op": [op], "value": [value]})

    rows = changes.where("user_key IS NOT NULL AND seq IS NOT NULL AND op IN (0, 1)").selectExpr("user_key", "seq", "cast(op as int) op", "value")
    return rows.groupBy("user_key").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


class PatchTable:
    """Live view of a change stream as files: each micro-batch becomes one set of patches, written once.

    The folder of a micro-batch is named by its number, so a batch that Spark runs again after a failure
    overwrites its own output. Every ``merge_every`` batches all patches so far are composed into one set,
    which counts from the moment it is whole; composition is associative, so nothing changes but the number
    of folders. Reading composes the merged set and the batches after it.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, merge_every: int = 16):
        self.spark, self.path, self.merge_every = spark, path or scratch(spark, "patches"), merge_every
        self.files = Files(spark, self.path)
        self.files.mkdirs()

    def _merged(self) -> int:
        """Number of the last batch in the newest whole merged set; -1 when there is none."""
        numbers = [int(n.partition("=")[2]) for n in self.files.folders("merged") if self.files.exists(f"merged/{n}/_SUCCESS")]
        return max(numbers, default=-1)

    def _folders(self, upto: int) -> list[str]:
        """The merged set, if any, and the batches after it."""
        batches = [n for n in self.files.folders() if n.startswith("batch=") and int(n.partition("=")[2]) > upto]
        return ([f"merged/upto={upto}"] if upto >= 0 else []) + batches

    def _patches(self, folders: list[str]) -> DataFrame:
        patches = self.spark.read.parquet(*[f"{self.path}/{f}" for f in folders])
        return compose_again(patches, ["_key"], ["value"], False)

    def write(self, batch: DataFrame, number: int) -> None:
        upto = self._merged()
        if number <= upto:
            return  # a batch that runs again after it was merged
        compose_patches(batch).write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        folders = self._folders(upto)
        if len(folders) > self.merge_every:
            self._patches(folders).write.mode("overwrite").parquet(f"{self.path}/merged/upto={number}")
            for f in folders:
                self.files.delete(f)

    def state(self) -> DataFrame:
        return apply_patches(self._patches(self._folders(self._merged())))


def run_to_end(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process all that is there, micro-batch by micro-batch, and stop; continues from the checkpoint."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest_of_files(spark: SparkSession, path: str, *, max_files: int = 100) -> DataFrame:
    """The current state of a feed that arrives as files, taken in as a stream."""
    schema = spark.read.parquet(path).schema
    table = PatchTable(spark)
    run_to_end(read_changes(spark, path, schema, max_files=max_files), table.write, scratch(spark, "checkpoint"))
    return table.state()
