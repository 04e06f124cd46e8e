"""The queries of problems 1 to 5 over the project's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import bloom
from tidemark.operators import changes, incremental, seen, skew, smallfiles
from tidemark.storage import scratch


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return changes.current_state(_table(spark, d, "oplog")).select("user_key", "seq")


def p1_state(spark: SparkSession, d: str) -> DataFrame:
    return changes.current_state(_table(spark, d, "oplog"))


def p1_state_after_batches(spark: SparkSession, d: str) -> DataFrame:
    """The op-log's state as base, and the batches' elements as the stream of changes applied to it."""
    base = changes.current_state(_table(spark, d, "oplog"))
    return changes.current_state(_elements(spark, d), base=base)


def _elements(spark: SparkSession, d: str) -> DataFrame:
    starts = _table(spark, d, "batch_header").where("batch_no IS NOT NULL AND starting_seq_number IS NOT NULL").select(F.col("batch_no").alias("_no"), "starting_seq_number").distinct()
    e = _table(spark, d, "batch")
    return e.join(starts, F.col("batch_no") == F.col("_no")).select("user_key", (F.col("starting_seq_number") + F.col("ordinal")).alias("seq"), "op", "value")


#: Batches in which the probes are asked of the ledger, one after the other in order of arrival.
PROBE_BATCHES = 3


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The probes are asked of a ledger that holds the filters' keys, in batches by order of arrival."""
    probes = _table(spark, d, "probes")
    batches = seen.cut_points(probes, "probe_id", PROBE_BATCHES)
    return seen.seen_before(probes, _table(spark, d, "filter_keys"), batches=batches).select("probe_id").distinct()


def p2_new_keys(spark: SparkSession, d: str) -> DataFrame:
    """The ledger itself after all probes: each key once, with the probe that brought it or none for the filters' keys.

    The ledger is reopened for each batch and asked each batch twice, as after a lost job.
    """
    probes, path = _table(spark, d, "probes"), scratch(spark, "ledger")
    bounds = [None, *seen.cut_points(probes, "probe_id", PROBE_BATCHES), None]
    for i, (low, high) in enumerate(zip(bounds, bounds[1:])):
        ledger = seen.KeyLedger(spark, path, most_generations=2)
        ledger.load(_table(spark, d, "filter_keys"), "user_key")
        part = probes.where((F.col("probe_id") > low if low is not None else F.lit(True)) & (F.col("probe_id") <= high if high is not None else F.lit(True)))
        for _ in range(2):
            ledger.ask(part, "user_key", "probe_id", f"batch {i}")
    ids = [seen.HISTORY, *(f"batch {i}" for i in range(len(bounds) - 1))]
    return ledger.new_keys(ids, "user_key", "probe_id")


def p2_exact_answers(spark: SparkSession, d: str) -> DataFrame:
    """The wrong answers that there must not be: of the ledger about any probe, and of a filter about a key of its own."""
    keys = _table(spark, d, "filter_keys")
    return bloom.ledger_errors(keys, _table(spark, d, "probes")).unionByName(bloom.own_key_errors(keys, _table(spark, d, "filter_blocks")))


def p2_wrong_answers(spark: SparkSession, d: str) -> DataFrame:
    """Measured rates of wrong answers: of the ledger (zero) and of the stored filters."""
    return bloom.filter_errors(_table(spark, d, "filter_keys"), _table(spark, d, "filter_blocks"), _table(spark, d, "probes"))


def _key_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of both tables as stored; the sequence number of a batch's element where a header tells it."""
    oplog = _table(spark, d, "oplog").select(F.lit("oplog").alias("table_name"), "user_key", "seq", "op", "value")
    starts = _table(spark, d, "batch_header").where("batch_no IS NOT NULL").groupBy(F.col("batch_no").alias("_no")).agg(F.max("starting_seq_number").alias("_start"))
    batch = _table(spark, d, "batch").join(starts, F.col("batch_no") == F.col("_no"), "left")
    return oplog.unionByName(batch.select(F.lit("batch").alias("table_name"), "user_key", (F.col("_start") + F.col("ordinal")).alias("seq"), "op", "value"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    stats = skew.key_statistics(_key_rows(spark, d), group=["table_name"])
    return skew.heavy_keys(stats, group="table_name").select("table_name", "user_key")


def p3_key_statistics(spark: SparkSession, d: str) -> DataFrame:
    return skew.key_statistics(_key_rows(spark, d), group=["table_name"])


def p3_value_profile(spark: SparkSession, d: str) -> DataFrame:
    return skew.value_profile(_key_rows(spark, d), group=["table_name"])


def _process(spark: SparkSession, d: str, items) -> DataFrame:
    return incremental.process_pending(spark, scratch(spark, "work"), _table(spark, d, "batch_header"), _table(spark, d, "batch"), _table(spark, d, "runs"), items=items)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """What the next run processes: ``runs`` are replayed into the ledger, what is pending is leased, written and reported done."""
    return _process(spark, d, incremental.delivered_items).select("seq")


def p4_next_operations(spark: SparkSession, d: str) -> DataFrame:
    """The next run's items with the operations they name."""
    return _process(spark, d, incremental.delivered_operations).drop("visible_at")


def p4_item_states(spark: SparkSession, d: str) -> DataFrame:
    """How many items are pending, leased and done after the runs of the log, when it ends."""
    items = incremental.delivered_items(_table(spark, d, "batch_header"), _table(spark, d, "batch"))
    ledger, now = incremental.replayed(spark, scratch(spark, "work"), _table(spark, d, "runs"))
    return incremental.item_states(items, ledger, now).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("least_seq"), F.max("seq").alias("greatest_seq"))


def _consolidated(spark: SparkSession, d: str) -> smallfiles.Consolidation:
    return smallfiles.consolidate(_table(spark, d, "oplog"), _table(spark, d, "edits"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The files that the consolidation replaced, from its commit."""
    return _consolidated(spark, d).replaced(spark).select("file_number")


def p5_replaced(spark: SparkSession, d: str) -> DataFrame:
    """The replaced files with their size and the number of their rows, as counted in the new files."""
    return _consolidated(spark, d).replaced(spark)


def p5_consolidated_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows in the consolidated files: exactly those that the op-log has in the small ones."""
    return _consolidated(spark, d).rows(spark)


def p5_live_after(spark: SparkSession, d: str) -> DataFrame:
    """Level and number of the old files that are live once the consolidation's edits are applied."""
    edits = _table(spark, d, "edits")
    old = edits.select("edit_no", "kind", "level", "file_number", "size")
    change = _consolidated(spark, d).edits(spark, edits)
    after = smallfiles.live_files(old.unionByName(change.select(old.columns)))
    new = change.where("kind = 'add'").select(F.col("file_number").alias("_new"))
    return after.join(new, F.col("file_number") == F.col("_new"), "left_anti").select("level", "file_number")


def p5_files(spark: SparkSession, d: str) -> DataFrame:
    """Number, rows and bytes of the files that the consolidation wrote, and of those that it replaces."""
    done = _consolidated(spark, d)
    new = done.files(spark).select(F.lit("written").alias("which"), F.col("size").alias("n_bytes"), "n_rows")
    old = done.replaced(spark).select(F.lit("replaced").alias("which"), F.col("size").alias("n_bytes"), "n_rows")
    files = new.unionByName(old).groupBy("which").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_rows").alias("n_rows"), F.min("n_bytes").alias("least_bytes"), F.percentile("n_bytes", F.lit(0.5)).alias("median_bytes"), F.max("n_bytes").alias("most_bytes"))
    return files


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_state, p1_state_after_batches, p2_found, p2_new_keys, p2_exact_answers, p2_wrong_answers, p3_found, p3_key_statistics, p3_value_profile, p4_found, p4_next_operations, p4_item_states, p5_found, p5_replaced, p5_consolidated_rows, p5_live_after, p5_files)
}

_VALID = "user_key IS NOT NULL AND seq IS NOT NULL AND op IN (0, 1)"
_NEWEST = "row_number() OVER (PARTITION BY user_key ORDER BY seq DESC, op DESC, value DESC NULLS LAST) AS rn"
_ELEMENTS = """SELECT b.user_key, h.starting_seq_number + b.ordinal AS seq, b.op, b.value FROM batch b
  JOIN (SELECT DISTINCT batch_no, starting_seq_number FROM batch_header WHERE starting_seq_number IS NOT NULL) h USING (batch_no)"""
_KEY_ROWS = """SELECT 'oplog' AS table_name, user_key, seq, op, value FROM oplog
  UNION ALL SELECT 'batch', b.user_key, h.s + b.ordinal, b.op, b.value FROM batch b
  LEFT JOIN (SELECT batch_no, max(starting_seq_number) AS s FROM batch_header GROUP BY 1) h USING (batch_no)"""
_DONE_UPTO = """(SELECT max(read_upto) FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY logged_at DESC) AS rn FROM runs) WHERE rn = 1 AND status = 'succeeded')"""
_LIVE = """SELECT level, file_number, size FROM (SELECT *, row_number() OVER (PARTITION BY file_number, level ORDER BY edit_no DESC) AS rn
  FROM edits WHERE file_number IS NOT NULL AND lower(trim(kind)) IN ('add', 'delete')) WHERE rn = 1 AND lower(trim(kind)) = 'add'"""
_PERCENTILE = "min(len) FILTER (WHERE upto >= greatest(1, ceil(n * {p})))"

SQL = {
    "p1_found": f"SELECT user_key, seq FROM (SELECT *, {_NEWEST} FROM oplog WHERE {_VALID}) WHERE rn = 1 AND op = 1",
    "p1_state": f"SELECT user_key, seq, value FROM (SELECT *, {_NEWEST} FROM oplog WHERE {_VALID}) WHERE rn = 1 AND op = 1",
    "p1_state_after_batches": f"""WITH c AS (SELECT user_key, seq, op, value FROM oplog UNION ALL {_ELEMENTS})
  SELECT user_key, seq, value FROM (SELECT *, {_NEWEST} FROM c WHERE {_VALID}) WHERE rn = 1 AND op = 1""",
    "p2_found": """WITH k AS (SELECT DISTINCT user_key FROM filter_keys WHERE user_key IS NOT NULL),
  f AS (SELECT user_key, min(probe_id) AS first FROM probes WHERE user_key IS NOT NULL GROUP BY 1)
  SELECT DISTINCT p.probe_id FROM probes p JOIN f USING (user_key) LEFT JOIN k USING (user_key)
  WHERE k.user_key IS NOT NULL OR p.probe_id > f.first""",
    "p2_exact_answers": """SELECT 'ledger' AS answered_by, count(DISTINCT probe_id) AS asked, 0 AS wrong_yes, 0 AS wrong_no, CAST(0 AS DOUBLE) AS rate FROM probes WHERE user_key IS NOT NULL
  UNION ALL SELECT 'filters, own keys', count(*), 0, 0, 0.0 FROM (SELECT DISTINCT user_key, file_number, block_offset // 2048 AS filter_index FROM filter_keys WHERE user_key IS NOT NULL)
  JOIN (SELECT DISTINCT file_number, filter_index, filter FROM filter_blocks WHERE filter IS NOT NULL) USING (file_number, filter_index)""",
    "p2_new_keys": """SELECT user_key, CASE WHEN k.user_key IS NULL THEN f.first END AS probe_id
  FROM (SELECT DISTINCT user_key FROM filter_keys WHERE user_key IS NOT NULL) k
  FULL JOIN (SELECT user_key, min(probe_id) AS first FROM probes WHERE user_key IS NOT NULL GROUP BY 1) f USING (user_key)""",
    "p3_found": f"""WITH r AS ({_KEY_ROWS}), n AS (SELECT table_name, user_key, count(*) AS n FROM r WHERE user_key IS NOT NULL GROUP BY 1, 2)
  SELECT table_name, user_key FROM (SELECT *, sum(n) OVER (PARTITION BY table_name) AS total FROM n) WHERE n > 0.01 * total""",
    "p3_key_statistics": f"""SELECT table_name, user_key, count(*) AS n_rows, count(*) FILTER (WHERE op = 1) AS n_puts,
  count(*) FILTER (WHERE op = 0) AS n_deletes, CAST(coalesce(sum(strlen(value)), 0) AS BIGINT) AS value_bytes, max(seq) AS newest_seq
  FROM ({_KEY_ROWS}) WHERE user_key IS NOT NULL GROUP BY 1, 2""",
    "p3_value_profile": f"""WITH r AS (SELECT table_name, user_key, value, strlen(value) AS len FROM ({_KEY_ROWS}) WHERE user_key IS NOT NULL AND value IS NOT NULL),
  s AS (SELECT table_name, user_key, len, count(*) AS w FROM r GROUP BY 1, 2, 3),
  u AS (SELECT *, sum(w) OVER (PARTITION BY table_name, user_key ORDER BY len) AS upto, sum(w) OVER (PARTITION BY table_name, user_key) AS n,
    row_number() OVER (PARTITION BY table_name, user_key ORDER BY w DESC, len) AS rn FROM s)
  SELECT u.table_name, u.user_key, v.n_values, CAST(min(len) FILTER (WHERE rn = 1) AS BIGINT) AS mode_bytes,
    CAST({_PERCENTILE.format(p="0.5::DOUBLE")} AS BIGINT) AS p50_bytes, CAST({_PERCENTILE.format(p="0.95::DOUBLE")} AS BIGINT) AS p95_bytes
  FROM u JOIN (SELECT table_name, user_key, count(DISTINCT value) AS n_values FROM r GROUP BY 1, 2) v USING (table_name, user_key) GROUP BY 1, 2, 3""",
    "p4_found": f"""SELECT h.starting_seq_number + b.ordinal AS seq FROM batch b JOIN batch_header h USING (batch_no)
  WHERE h.starting_seq_number IS NOT NULL AND h.arrived_at IS NOT NULL GROUP BY 1 HAVING min(h.arrived_at) > {_DONE_UPTO}""",
    "p4_next_operations": f"""WITH c AS (SELECT h.starting_seq_number + b.ordinal AS seq, h.arrived_at, b.batch_no, b.op, b.user_key, b.value
  FROM batch b JOIN batch_header h USING (batch_no) WHERE h.starting_seq_number IS NOT NULL AND h.arrived_at IS NOT NULL)
  SELECT seq, batch_no, op, user_key, value FROM (SELECT *, row_number() OVER (PARTITION BY seq
    ORDER BY arrived_at, batch_no, op NULLS FIRST, user_key NULLS FIRST, value NULLS FIRST) AS rn FROM c)
  WHERE rn = 1 AND arrived_at > {_DONE_UPTO}""",
    "p5_found": f"SELECT DISTINCT file_number FROM ({_LIVE}) WHERE size < 524288",
    "p5_replaced": f"""SELECT f.file_number, f.size, coalesce(o.n, 0) AS n_rows FROM (SELECT file_number, min(size) AS size FROM ({_LIVE}) WHERE size < 524288 GROUP BY 1) f
  LEFT JOIN (SELECT file_number, count(*) AS n FROM oplog GROUP BY 1) o USING (file_number)""",
    "p5_live_after": f"SELECT level, file_number FROM ({_LIVE}) WHERE file_number NOT IN (SELECT file_number FROM ({_LIVE}) WHERE size < 524288)",
    "p5_consolidated_rows": f"SELECT o.* FROM oplog o WHERE file_number IN (SELECT file_number FROM ({_LIVE}) WHERE size < 524288)",
}
SQL["p4_item_states"] = f"""SELECT CASE WHEN visible_at <= {_DONE_UPTO} THEN 'done' ELSE 'pending' END AS state, count(*) AS n, min(seq) AS least_seq, max(seq) AS greatest_seq FROM (
  SELECT h.starting_seq_number + b.ordinal AS seq, min(h.arrived_at) AS visible_at FROM batch b JOIN batch_header h USING (batch_no)
  WHERE h.starting_seq_number IS NOT NULL AND h.arrived_at IS NOT NULL GROUP BY 1) GROUP BY 1"""
