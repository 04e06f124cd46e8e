"""Queries of the key-value engine over the op-log, the batches and the manifest's edits, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import bloom
from tidemark.functions import bytes as b
from tidemark.operators import compaction, merge, order, reads, versions, writes
from tidemark.schema import NEWEST, oplog
from tidemark.sources import connectors
from tidemark.storage import scratch
from tidemark.store import Batch, Options, Snapshot, Store
from tidemark.streaming import ingest

SNAPSHOT = 5000
KEY = "u77"
LO, HI = "k", "sess"
PREFIX = "acct/"
POINTER = "m"


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _log(spark, d) -> DataFrame:
    return oplog(_table(spark, d, "oplog"))


def _feed(spark, d) -> DataFrame:
    """The op-log with its repeated rows, for reads, which absorb them."""
    return oplog(_table(spark, d, "oplog"), once=False)


def _files(spark, d) -> DataFrame:
    return versions.fold_edits(_table(spark, d, "edits"))


_LOG = "(SELECT DISTINCT user_key, seq, CAST(op AS INTEGER) AS op, CASE WHEN op = 1 THEN value END AS value FROM oplog WHERE user_key IS NOT NULL AND seq IS NOT NULL AND op IN (0, 1))"
_FILES = """(SELECT level, file_number, size, lo_key, lo_seq, hi_key, hi_seq FROM (SELECT *, row_number() OVER (PARTITION BY file_number, level ORDER BY edit_no DESC) AS rn
  FROM edits WHERE file_number IS NOT NULL AND lower(trim(kind)) IN ('add', 'delete')) WHERE rn = 1 AND lower(trim(kind)) = 'add')"""


def _live(where: str = "TRUE") -> str:
    return f"(SELECT user_key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS rn FROM {_LOG} WHERE {where}) WHERE rn = 1 AND op = 1)"


QUERIES, SQL = {}, {}


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- point reads


@_query(f"SELECT * FROM {_live(f'''user_key = '{KEY}' ''')}")
def get_point(spark, d):
    return reads.get(_feed(spark, d), KEY)


@_query(f"SELECT * FROM {_live(f'''user_key = '{KEY}' AND seq <= {SNAPSHOT}''')}")
def get_point_snapshot(spark, d):
    return reads.get(_feed(spark, d), KEY, SNAPSHOT)


@_query(f"SELECT * FROM {_live('''user_key = 'no such key' ''')}")
def get_missing(spark, d):
    return reads.get(_feed(spark, d), "no such key")


@_query(f"""SELECT a.user_key, l.seq IS NOT NULL AS found, l.seq, l.value FROM (SELECT DISTINCT user_key FROM probes WHERE user_key IS NOT NULL) a
  LEFT JOIN {_live()} l USING (user_key)""")
def multi_get(spark, d):
    return reads.multi_get(_feed(spark, d), _table(spark, d, "probes"))


@_query(f"SELECT level, file_number, size FROM {_FILES} WHERE lo_key <= '{KEY}' AND hi_key >= '{KEY}'")
def files_for_key(spark, d):
    return versions.files_for_key(_files(spark, d), KEY).select("level", "file_number", "size")


@_query(f"""SELECT level, file_number, hi_key FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY hi_key, hi_seq DESC, file_number) AS rn
  FROM {_FILES} WHERE hi_key >= '{KEY}') WHERE rn = 1""")
def find_file(spark, d):
    return versions.first_file_at_or_after(_files(spark, d), KEY)


# --- ordered reads


@_query(f"SELECT * FROM {_live()}")
def scan_live(spark, d):
    return reads.scan(_feed(spark, d))


@_query(f"SELECT * FROM {_live(f'seq <= {SNAPSHOT}')}")
def scan_snapshot(spark, d):
    return reads.scan(_feed(spark, d), SNAPSHOT)


@_query(f"SELECT user_key, value, row_number() OVER (ORDER BY user_key DESC) AS position FROM {_live()}")
def scan_reverse_rank(spark, d):
    return order.positions(reads.scan(_feed(spark, d)).select("user_key", "value"), [F.desc("user_key")])


@_query(f"SELECT * FROM {_live(f'''user_key >= '{LO}' AND user_key < '{HI}' AND seq <= {SNAPSHOT}''')}")
def range_scan(spark, d):
    return reads.range_scan(_feed(spark, d), LO, HI, SNAPSHOT)


@_query(f"SELECT * FROM {_live(f'''starts_with(user_key, '{PREFIX}')''')}")
def prefix_scan(spark, d):
    return reads.prefix_scan(_feed(spark, d), PREFIX)


@_query(f"SELECT * FROM {_live()} ORDER BY user_key LIMIT 1")
def seek_first(spark, d):
    return reads.seek_first(reads.scan(_feed(spark, d)))


@_query(f"SELECT * FROM {_live()} ORDER BY user_key DESC LIMIT 1")
def seek_last(spark, d):
    return reads.seek_last(reads.scan(_feed(spark, d)))


@_query(f"SELECT * FROM {_live()} WHERE user_key >= '{LO}' ORDER BY user_key LIMIT 1")
def seek_ge(spark, d):
    return reads.seek(reads.scan(_feed(spark, d)), LO)


@_query(f"SELECT * FROM {_live()} WHERE user_key > '{LO}' ORDER BY user_key LIMIT 10")
def next_n(spark, d):
    return reads.next_rows(reads.scan(_feed(spark, d)), LO, 10)


@_query(f"SELECT * FROM {_live()} WHERE user_key < '{HI}' ORDER BY user_key DESC LIMIT 10")
def prev_n(spark, d):
    return reads.prev_rows(reads.scan(_feed(spark, d)), HI, 10)


@_query(f"SELECT user_key, lag(user_key) OVER (ORDER BY user_key) AS prev_key, lead(user_key) OVER (ORDER BY user_key) AS next_key FROM {_live()}")
def neighbours(spark, d):
    return order.neighbours(reads.scan(_feed(spark, d)).select("user_key"), "user_key")


def _runs(spark, d) -> list[DataFrame]:
    log = _log(spark, d)
    return [log.where(F.col("seq") % 3 == i) for i in range(3)]


@_query(f"SELECT *, row_number() OVER (ORDER BY user_key, seq DESC) AS position FROM {_LOG}")
def merge_runs(spark, d):
    return merge.ranked(merge.merge_runs(_runs(spark, d)))


@_query(f"SELECT *, row_number() OVER (ORDER BY user_key DESC, seq) AS position FROM {_LOG}")
def merge_runs_reverse(spark, d):
    return merge.ranked(merge.merge_runs(_runs(spark, d)), reverse=True)


@_query(f"SELECT o.* FROM oplog o WHERE o.file_number IN (SELECT file_number FROM {_FILES} WHERE level = 2)")
def concat_level(spark, d):
    return merge.concat_level(_table(spark, d, "oplog"), _files(spark, d), 2)


@_query(f"SELECT count(*) FILTER (WHERE level = 0) + count(DISTINCT level) FILTER (WHERE level BETWEEN 1 AND 6) AS n_runs FROM {_FILES}")
def run_count(spark, d):
    return merge.run_count(_files(spark, d))


# --- writes

_START = "(SELECT DISTINCT batch_no, starting_seq_number FROM batch_header WHERE starting_seq_number IS NOT NULL)"
_SIZE = "9 + coalesce(strlen(user_key), 0) + coalesce(strlen(value), 0)"


@_query(f"""SELECT batch_no, user_key, seq, op, value FROM (SELECT b.batch_no, b.user_key, h.starting_seq_number + b.ordinal AS seq, b.op, b.value,
  row_number() OVER (PARTITION BY b.batch_no, b.user_key ORDER BY b.ordinal DESC) AS rn FROM batch b JOIN {_START} h USING (batch_no)
  WHERE user_key IS NOT NULL AND op IN (0, 1)) WHERE rn = 1""")
def batch_apply_order(spark, d):
    return writes.batch_result(_table(spark, d, "batch"), _table(spark, d, "batch_header"))


@_query(f"SELECT batch_no, count(*) AS n_elements, CAST(sum({_SIZE}) AS BIGINT) AS size FROM batch GROUP BY 1")
def batch_sizes(spark, d):
    return writes.batch_sizes(_table(spark, d, "batch"))


@_query(f"""WITH q AS (SELECT s.batch_no, s.size, coalesce(h.sync, FALSE) AS synchronous FROM (SELECT batch_no, CAST(sum({_SIZE}) AS BIGINT) AS size FROM batch GROUP BY 1) s
  LEFT JOIN (SELECT batch_no, bool_or(synchronous) AS sync FROM batch_header GROUP BY 1) h USING (batch_no)),
  r AS (SELECT *, row_number() OVER w AS n, sum(size) OVER w AS upto, first(size) OVER w AS lead_size, first(synchronous) OVER w AS lead_sync FROM q
    WINDOW w AS (ORDER BY batch_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  t AS (SELECT *, max(CASE WHEN n > 1 AND (upto > CASE WHEN lead_size <= 131072 THEN lead_size + 131072 ELSE 1048576 END OR (synchronous AND NOT lead_sync)) THEN 1 ELSE 0 END)
    OVER (ORDER BY batch_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stopped FROM r)
  SELECT batch_no, size, synchronous FROM t WHERE stopped = 0""")
def group_commit_cut(spark, d):
    sync = _table(spark, d, "batch_header").where("batch_no IS NOT NULL").groupBy(F.col("batch_no").alias("_no")).agg(F.bool_or("synchronous").alias("synchronous"))
    sizes = writes.batch_sizes(_table(spark, d, "batch")).join(sync, F.col("batch_no") == F.col("_no"), "left")
    return writes.group_commit(sizes.select("batch_no", "size", F.coalesce("synchronous", F.lit(False)).alias("synchronous")))


@_query("""SELECT l_orderkey, l_linenumber, 1000 + row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS seq
  FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)""")
def assign_sequence(spark, d):
    rows = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return writes.assign_sequence(rows, [F.col("l_orderkey"), F.col("l_linenumber")], 1000)


# --- versions

@_query(f"SELECT user_key, seq, value FROM {_live(f'seq <= 2 * {SNAPSHOT}')} WHERE seq > {SNAPSHOT}")
def snapshot_diff(spark, d):
    return reads.snapshot_diff(_feed(spark, d), SNAPSHOT, 2 * SNAPSHOT)


@_query(f"SELECT * FROM {_FILES}")
def version_fold(spark, d):
    return _files(spark, d)


@_query("""SELECT arg_max(wal_number, edit_no) AS wal_number, arg_max(prev_sequence_number, edit_no) AS prev_sequence_number
  FROM edits WHERE lower(trim(kind)) = 'scalar' AND edit_no IS NOT NULL""")
def version_scalars(spark, d):
    return versions.scalars(_table(spark, d, "edits"))


def _versions(spark, d) -> list[DataFrame]:
    edits = _table(spark, d, "edits")
    return [versions.fold_edits(edits.where(F.col("edit_no") <= n)) for n in (400, 800)] + [versions.fold_edits(edits)]


def _fold_upto(n: str) -> str:
    return _FILES.replace("WHERE file_number IS NOT NULL", f"WHERE edit_no <= {n} AND file_number IS NOT NULL")


_LIVE_NUMBERS = f"(SELECT file_number FROM {_fold_upto('400')} UNION SELECT file_number FROM {_fold_upto('800')} UNION SELECT file_number FROM {_FILES})"


@_query(f"SELECT file_number FROM {_LIVE_NUMBERS}")
def live_files(spark, d):
    return versions.live_numbers(_versions(spark, d))


@_query(f"SELECT DISTINCT file_number FROM edits WHERE file_number IS NOT NULL AND file_number NOT IN {_LIVE_NUMBERS}")
def obsolete_files(spark, d):
    return versions.obsolete_numbers(_table(spark, d, "edits"), versions.live_numbers(_versions(spark, d)))


# --- flush and compaction planning


@_query(f"SELECT level, file_number FROM {_FILES} WHERE NOT (hi_key < '{LO}' OR lo_key > '{HI}')")
def overlap_files(spark, d):
    return versions.overlapping(_files(spark, d), LO, HI).select("level", "file_number")


@_query(f"""WITH f AS (SELECT * FROM {_FILES} WHERE level = 0 AND lo_key IS NOT NULL AND hi_key IS NOT NULL), m AS (SELECT *, max(hi_key) OVER (ORDER BY lo_key, hi_key, file_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f),
  i AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo_key > reach THEN 1 ELSE 0 END) OVER (ORDER BY lo_key, hi_key, file_number) AS island FROM m)
  SELECT file_number FROM i WHERE island IN (SELECT island FROM i WHERE lo_key <= 'c' AND hi_key >= 'b')""")
def overlap_l0_transitive(spark, d):
    return versions.grown_overlap(_files(spark, d), "b", "c").select("file_number")


@_query(f"""SELECT level, CASE WHEN level = 0 THEN CAST(floor(count(*) / 4) AS DOUBLE) ELSE coalesce(sum(size), 0)::DOUBLE / (pow(10.0, level) * 1048576) END AS score
  FROM {_FILES} WHERE level BETWEEN 0 AND 6 GROUP BY level""")
def level_scores(spark, d):
    return versions.level_scores(_files(spark, d))


@_query(f"""SELECT level, score FROM (SELECT level, CASE WHEN level = 0 THEN CAST(floor(count(*) / 4) AS DOUBLE) ELSE coalesce(sum(size), 0)::DOUBLE / (pow(10.0, level) * 1048576) END AS score
  FROM {_FILES} WHERE level BETWEEN 0 AND 5 GROUP BY level) WHERE score >= 1 ORDER BY score DESC, level LIMIT 1""")
def compaction_level(spark, d):
    return versions.compaction_level(_files(spark, d))


@_query(f"""SELECT level, file_number FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY coalesce(hi_key > '{POINTER}', FALSE) DESC, lo_key, lo_seq DESC, file_number) AS rn FROM {_FILES}) WHERE rn = 1""")
def pick_file_round_robin(spark, d):
    return versions.pick_round_robin(_files(spark, d), POINTER)


@_query(f"""SELECT CASE WHEN n0 = 0 AND n1 = 0 AND b2 <= 20971520 THEN CASE WHEN n2 = 0 AND b3 <= 20971520 THEN 2 ELSE 1 END ELSE 0 END AS level FROM (
  SELECT count(*) FILTER (WHERE level = 0) AS n0, count(*) FILTER (WHERE level = 1) AS n1, count(*) FILTER (WHERE level = 2) AS n2,
  coalesce(sum(size) FILTER (WHERE level = 2), 0) AS b2, coalesce(sum(size) FILTER (WHERE level = 3), 0) AS b3 FROM {_FILES} WHERE lo_key <= 'zz' AND hi_key >= 'zy')""")
def flush_level(spark, d):
    return versions.flush_level(_files(spark, d), "zy", "zz")


_MET = f"""(SELECT f.level, f.file_number, count(g.file_number) AS n_down, CAST(coalesce(sum(g.size), 0) AS BIGINT) AS bytes_down FROM {_FILES} f
  LEFT JOIN {_FILES} g ON g.level = f.level + {{down}} AND g.lo_key <= f.hi_key AND g.hi_key >= f.lo_key GROUP BY 1, 2)"""


@_query(f"SELECT * FROM {_MET.format(down=1)}")
def next_level_overlap(spark, d):
    return versions.overlap_with_level(_files(spark, d), 1).select("level", "file_number", "n_down", "bytes_down")


@_query(f"SELECT coalesce(max(bytes_down), 0) AS max_bytes FROM {_MET.format(down=1)} WHERE level >= 1")
def max_next_level_overlap(spark, d):
    return versions.max_next_level_overlap(_files(spark, d))


@_query(f"""SELECT p.level, p.file_number, g.bytes_down AS grandparent_bytes FROM {_MET.format(down=1)} p JOIN {_MET.format(down=2)} g USING (level, file_number)
  WHERE p.level < 6 AND p.n_down = 0 AND g.bytes_down <= 20971520""")
def trivial_moves(spark, d):
    return versions.trivial_moves(_files(spark, d))


@_query(f"""SELECT f.level, f.file_number, g.file_number AS before_file FROM {_FILES} f JOIN {_FILES} g ON g.level = f.level AND f.lo_key = g.hi_key AND f.lo_seq < g.hi_seq
  WHERE f.level >= 1""")
def boundary_files(spark, d):
    return versions.boundary_files(_files(spark, d))


@_query(f"""SELECT f.level, f.file_number, count(*) AS n_others FROM {_FILES} f JOIN {_FILES} g ON g.level = f.level AND g.file_number <> f.file_number
  AND g.lo_key <= f.hi_key AND g.hi_key >= f.lo_key WHERE f.level >= 1 GROUP BY 1, 2""")
def disjointness_check(spark, d):
    return versions.disjointness_violations(_files(spark, d))


_KEEP = f"""(SELECT user_key, seq, op, value FROM (SELECT *, lag(seq) OVER (PARTITION BY user_key ORDER BY seq DESC) AS newer FROM {_LOG})
  WHERE (newer IS NULL OR newer > {SNAPSHOT}) AND NOT (op = 0 AND seq <= {SNAPSHOT}))"""


@_query(f"SELECT * FROM {_KEEP}")
def compact_keep(spark, d):
    return compaction.keep(_log(spark, d), SNAPSHOT)


@_query(f"SELECT * FROM {_live()}")
def compact_then_scan(spark, d):
    return reads.scan(compaction.keep(_log(spark, d), SNAPSHOT))


@_query(f"SELECT * FROM {_live(f'seq <= {SNAPSHOT}')}")
def compact_then_scan_snapshot(spark, d):
    return reads.scan(compaction.keep(_log(spark, d), SNAPSHOT), SNAPSHOT)


@_query(f"""SELECT user_key, seq FROM (SELECT user_key, max(seq) AS seq FROM {_LOG} WHERE op = 0 GROUP BY 1) d
  WHERE NOT EXISTS (SELECT 1 FROM {_FILES} f WHERE f.level >= 3 AND f.lo_key <= d.user_key AND f.hi_key >= d.user_key)""")
def tombstone_base_level(spark, d):
    deletes = _log(spark, d).where("op = 0").groupBy("user_key").agg(F.max("seq").alias("seq"))
    return compaction.deletes_at_base_level(deletes, _files(spark, d).where("level >= 3"))


# --- snapshots taken from the data: they cover the same part of a log of any size

_HALF = f"(SELECT max(seq) // 2 FROM {_LOG})"
_RECENT = f"(SELECT max(seq) * 9 // 10 FROM {_LOG})"


def _half(log: DataFrame) -> Column:
    """Half of the greatest sequence number; null for an empty log."""
    return log.agg(F.expr("max(seq) div 2")).scalar()


def _recent(log: DataFrame) -> Column:
    """Nine tenths of the greatest sequence number."""
    return log.agg(F.expr("max(seq) * 9 div 10")).scalar()


@_query(f"SELECT * FROM {_live(f"""user_key = '{KEY}' AND seq <= {_HALF}""")}")
def get_point_half(spark, d):
    return reads.get(_feed(spark, d), KEY, _half(_feed(spark, d)))


@_query(f"SELECT * FROM {_live(f'seq <= {_HALF}')}")
def scan_half(spark, d):
    return reads.scan(_feed(spark, d), _half(_feed(spark, d)))


@_query(f"SELECT * FROM {_live(f"""user_key >= '{LO}' AND user_key < '{HI}'""")}")
def range_scan_newest(spark, d):
    return reads.range_scan(_feed(spark, d), LO, HI)


@_query(f"SELECT user_key, seq, value FROM {_live()} WHERE seq > {_HALF}")
def diff_half_newest(spark, d):
    """Live rows of the newest state that were not the same at half of the log."""
    return reads.snapshot_diff(_feed(spark, d), _half(_feed(spark, d)), NEWEST)


@_query(f"""SELECT user_key, seq, op, value FROM (SELECT *, lag(seq) OVER (PARTITION BY user_key ORDER BY seq DESC) AS newer FROM {_LOG})
  WHERE (newer IS NULL OR newer > {_RECENT}) AND NOT (op = 0 AND seq <= {_RECENT})""")
def compact_keep_recent(spark, d):
    return compaction.keep(_log(spark, d), _recent(_feed(spark, d)))


@_query(f"SELECT * FROM {_live()}")
def compact_recent_then_scan(spark, d):
    return reads.scan(compaction.keep(_log(spark, d), _recent(_feed(spark, d))))


@_query(f"SELECT * FROM {_live(f'seq <= {_RECENT}')}")
def compact_recent_then_scan_snapshot(spark, d):
    recent = _recent(_feed(spark, d))
    return reads.scan(compaction.keep(_log(spark, d), recent), recent)


# --- statistics


@_query(f"SELECT CAST(l.range AS INTEGER) AS level, count(f.file_number) AS n_files, CAST(coalesce(sum(size), 0) AS BIGINT) AS n_bytes FROM range(7) l LEFT JOIN {_FILES} f ON f.level = l.range GROUP BY 1")
def files_per_level(spark, d):
    return versions.summaries(_files(spark, d))


@_query(f"SELECT 'files[ ' || string_agg(n::VARCHAR, ' ' ORDER BY level) || ' ]' AS summary FROM (SELECT l.range AS level, count(f.file_number) AS n FROM range(7) l LEFT JOIN {_FILES} f ON f.level = l.range GROUP BY 1)")
def level_summary(spark, d):
    return versions.level_summary(_files(spark, d))


@_query(f"""SELECT level, min({{'k': lo_key, 's': -lo_seq}}).k AS lo_key, -(min({{'k': lo_key, 's': -lo_seq}}).s) AS lo_seq,
  max({{'k': hi_key, 's': -hi_seq}}).k AS hi_key, -(max({{'k': hi_key, 's': -hi_seq}}).s) AS hi_seq FROM {_FILES} WHERE lo_key IS NOT NULL AND hi_key IS NOT NULL GROUP BY 1""")
def key_range(spark, d):
    return versions.key_range(_files(spark, d), ["level"])


@_query(f"""SELECT level, file_number || ':' || coalesce(size::VARCHAR, '') || '[' || coalesce(lo_key, '') || ' @ ' || coalesce(lo_seq::VARCHAR, '') || ' .. '
  || coalesce(hi_key, '') || ' @ ' || coalesce(hi_seq::VARCHAR, '') || ']' AS line FROM {_FILES}""")
def tables_text(spark, d):
    return versions.tables_text(_files(spark, d))


@_query(f"SELECT count(*) AS n_entries, CAST(sum({_SIZE}) AS BIGINT) AS n_bytes FROM {_LOG}")
def memtable_statistics(spark, d):
    return _log(spark, d).agg(F.count(F.lit(1)).alias("n_entries"), F.sum(writes.element_size()).alias("n_bytes"))


# --- functions


def _escaped(key: str) -> str:
    for plain, shown in b.ESCAPES.items():
        chars = " || ".join(f"chr({ord(c)})" for c in shown)
        key = f"replace({key}, chr({ord(plain)}), {chars})"
    return key


@_query(f"SELECT seq, {_escaped('user_key')} || ' @ ' || seq || ' : ' || CASE op WHEN 1 THEN 'Put' ELSE 'Delete' END AS text, strlen(user_key) + 9 AS n_bytes FROM {_LOG}")
def key_text(spark, d):
    log = _log(spark, d)
    return log.select("seq", b.key_text(F.col("user_key"), F.col("seq"), F.col("op")).alias("text"), b.key_bytes(F.col("user_key")).alias("n_bytes"))


_BYTES = "list_transform(range(0, length({h}) // 2), lambda i: CAST('0x' || substr({h}, 2 * i + 1, 2) AS BIGINT))"


@_query(f"""WITH k AS (SELECT user_key, hex(user_key) AS a, lead(hex(user_key)) OVER (ORDER BY user_key) AS z FROM {_live()}),
  x AS (SELECT *, {_BYTES.format(h="a")} AS p, {_BYTES.format(h="coalesce(z, '')")} AS q FROM k),
  n AS (SELECT *, list_filter(range(1, 1 + least(len(p), len(q))), lambda i: p[i] <> q[i])[1] AS d, list_filter(range(1, 1 + len(p)), lambda i: p[i] <> 255)[1] AS s FROM x)
  SELECT user_key, CASE WHEN z IS NULL THEN NULL WHEN d IS NULL OR p[d] + 1 >= q[d] THEN a ELSE left(a, CAST(2 * d - 2 AS BIGINT)) || printf('%02X', p[d] + 1) END AS separator,
    CASE WHEN s IS NULL THEN a ELSE left(a, CAST(2 * s - 2 AS BIGINT)) || printf('%02X', p[s] + 1) END AS successor FROM n""")
def separators(spark, d):
    """A separator of each live key and the next, and a successor of each."""
    near = order.neighbours(reads.scan(_feed(spark, d)).select("user_key"), "user_key")
    key, after = F.col("user_key").cast("binary"), F.col("next_key").cast("binary")
    return near.select("user_key", F.hex(b.separator_of(key, after)).alias("separator"), F.hex(b.successor_of(key)).alias("successor"))


# the fixed values are those of functions.bytes and functions.bloom
_CRC = """xor(list_reduce(p, lambda c, x: list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda a, y: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 2197175160) ELSE a >> 1 END, xor(c, x)), 4294967295), 4294967295)"""
_M32 = "% 4294967296"
_MIXED = f"((h + w) {_M32} * 3332679571::HUGEINT {_M32})::BIGINT"


# hash and checksum of the keys of a table of user_key and h, its bytes in hexadecimal
_HASHES = f"""(WITH x AS (SELECT user_key, {_BYTES.format(h="h")} AS p, length(h) // 2 AS n FROM {{keys}}),
  c AS (SELECT user_key, p, n, {_CRC} AS crc32c, xor(3164544308, CAST(n * 3332679571::HUGEINT {_M32} AS BIGINT)) AS seed,
    list_transform(range(0, n // 4), lambda i: p[4 * i + 1] + 256 * p[4 * i + 2] + 65536 * p[4 * i + 3] + 16777216 * p[4 * i + 4]) AS words FROM x),
  m AS (SELECT *, list_reduce(words, lambda h, w: xor({_MIXED}, {_MIXED} >> 16), seed) AS h,
    list_reduce(p[4 * (n // 4) + 1:], lambda a, y, i: a + y * (1 << CAST(8 * (i - 1) AS BIGINT)), CAST(0 AS BIGINT)) AS w FROM c)
  SELECT user_key, CASE WHEN n % 4 = 0 THEN h ELSE xor({_MIXED}, {_MIXED} >> 24) END AS hash, crc32c FROM m)"""


@_query(f"""SELECT user_key, hash, crc32c, (((crc32c >> 15) | ((crc32c & 32767) << 17)) + 2726488792) {_M32} AS stored
  FROM {_HASHES.format(keys=f"(SELECT DISTINCT user_key, hex(user_key) AS h FROM {_LOG})")}""")
def checksums(spark, d):
    """Hash, checksum and its stored form of each key."""
    key = F.col("user_key").cast("binary")
    rows = _log(spark, d).select("user_key").distinct().select("user_key", bloom.bloom_hash(key).alias("hash"), b.crc32c_of(key).alias("crc32c"))
    return rows.withColumn("stored", b.masked(F.col("crc32c")))


@_query("SELECT DISTINCT file_number, filter_index FROM filter_blocks WHERE FALSE")
def bloom_no_false_negative(spark, d):
    """Stored filters that deny one of their own keys: there must be none."""
    keys = _table(spark, d, "filter_keys").where("user_key IS NOT NULL").select("file_number", F.expr("block_offset div 2048").alias("filter_index"), F.col("user_key").cast("binary").alias("key")).distinct()
    asked = keys.join(_table(spark, d, "filter_blocks").where("filter IS NOT NULL"), ["file_number", "filter_index"])
    return asked.where(~bloom.key_may_match(F.col("key"), F.col("filter"))).select("file_number", "filter_index").distinct()


@_query(f"""WITH k AS (SELECT DISTINCT user_key, file_number, block_offset // 2048 AS i FROM filter_keys WHERE user_key IS NOT NULL),
  a AS (SELECT user_key, file_number, i AS filter_index FROM k UNION SELECT user_key, file_number, i + 1 FROM k),
  f AS (SELECT DISTINCT file_number, filter_index, hex(filter) AS f FROM filter_blocks WHERE filter IS NOT NULL),
  h AS {_HASHES.format(keys="(SELECT DISTINCT user_key, hex(user_key) AS h FROM filter_keys WHERE user_key IS NOT NULL)")},
  q AS (SELECT *, length(f) * 4 - 8 AS n_bits, CAST('0x' || left(f, 2) AS BIGINT) AS k, (hash >> 17) | ((hash << 15) {_M32}) AS delta FROM a JOIN f USING (file_number, filter_index) JOIN h USING (user_key))
  SELECT user_key, file_number, filter_index, len(list_filter(range(0, k), lambda i:
    (CAST('0x' || substr(f, 3 + 2 * ((((hash + i * delta) {_M32}) % n_bits) // 8), 2) AS BIGINT) >> ((((hash + i * delta) {_M32}) % n_bits) % 8)) & 1 = 0)) = 0 AS may_match FROM q""")
def bloom_membership(spark, d):
    """Every key asked of the filter of its block and of the block after it."""
    keys = _table(spark, d, "filter_keys").where("user_key IS NOT NULL").select("user_key", "file_number", F.expr("block_offset div 2048").alias("i"))
    asked = keys.select("user_key", "file_number", F.explode(F.array("i", F.col("i") + 1)).alias("filter_index")).distinct()
    blocks = _table(spark, d, "filter_blocks").where("filter IS NOT NULL").select("file_number", "filter_index", "filter").distinct()
    both = asked.join(blocks, ["file_number", "filter_index"])
    return both.select("user_key", "file_number", "filter_index", bloom.key_may_match(F.col("user_key").cast("binary"), F.col("filter")).alias("may_match"))


@_query("""SELECT file_number, filter_index, hex(filter) AS filter FROM (SELECT DISTINCT file_number, filter_index, filter FROM filter_blocks WHERE filter IS NOT NULL)""")
def build_filters(spark, d):
    """Filters built anew from the keys of each block; equal to the stored ones."""
    keys = _table(spark, d, "filter_keys").select("file_number", F.expr("block_offset div 2048").alias("filter_index"), F.col("user_key").cast("binary").alias("key")).distinct()
    stored = _table(spark, d, "filter_blocks").where("filter IS NOT NULL").select("file_number", "filter_index", "n_keys").distinct()
    return bloom.build_filters(keys.join(stored, ["file_number", "filter_index"]), ["file_number", "filter_index", "n_keys"], "key", n_keys="n_keys").select("file_number", "filter_index", F.hex("filter").alias("filter"))


@_query("SELECT DISTINCT file_number, CAST(regexp_extract(file_number || '.rdb', '^(\\d+)', 1) AS BIGINT) AS parsed FROM edits WHERE file_number IS NOT NULL")
def file_numbers(spark, d):
    numbers = _table(spark, d, "edits").where("file_number IS NOT NULL").select("file_number").distinct()
    return numbers.select("file_number", b.file_number(F.concat(F.lit("data/"), F.col("file_number").cast("string"), F.lit(".rdb"))).alias("parsed"))


# --- native files and streams


@_query(f"SELECT user_key, seq, op, value FROM {_LOG} WHERE seq IN (SELECT seq FROM {_LOG} GROUP BY 1 HAVING count(*) = 1)")
def wal_roundtrip(spark, d):
    """The op-log's operations written as logs and read back; a number that two keys have is no log's."""
    folder = scratch(spark, "wal")
    log = _log(spark, d)
    once = log.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.first("user_key").alias("user_key"), F.first("op").alias("op"), F.first("value").alias("value")).where("n = 1")
    connectors.write_logs(once, folder, files=8).collect()
    back = connectors.read_logs(spark, folder)
    return back.select(F.col("user_key").cast("string").alias("user_key"), "seq", "op", F.col("value").cast("string").alias("value"))


@_query(f"SELECT user_key, seq, op, CASE WHEN op = 1 THEN coalesce(value, '') END AS value FROM {_LOG}")
def table_roundtrip(spark, d):
    """The op-log written as table files and read back; the format has no null value of a put."""
    folder = scratch(spark, "tables")
    connectors.write_tables(_log(spark, d), folder).collect()
    back = connectors.read_tables(spark, folder)
    return back.select(F.col("user_key").cast("string").alias("user_key"), "seq", "op", F.col("value").cast("string").alias("value"))


_OF_ADD = "CASE WHEN lower(trim(kind)) = 'add' THEN coalesce({c}, {none}) END AS {c}"


@_query(f"""SELECT DISTINCT lower(trim(kind)) AS kind, level, file_number, wal_number, prev_sequence_number,
  {', '.join(_OF_ADD.format(c=c, none=n) for c, n in (("size", 0), ("lo_key", "''"), ("lo_seq", 0), ("hi_key", "''"), ("hi_seq", 0)))}
  FROM edits WHERE edit_no IS NOT NULL AND lower(trim(kind)) IN ('add', 'delete', 'scalar')""")
def manifest_roundtrip(spark, d):
    folder = scratch(spark, "manifests")
    connectors.write_manifests(_table(spark, d, "edits"), folder, files=4).collect()
    back = connectors.read_manifests(spark, folder)
    keys = {c: F.col(c).cast("string") for c in ("lo_key", "hi_key")}
    return back.withColumns(keys).select("kind", "level", "file_number", "size", "lo_key", "lo_seq", "hi_key", "hi_seq", "wal_number", "prev_sequence_number").distinct()


@_query(f"SELECT * FROM {_live()}")
def stream_latest(spark, d):
    """The op-log taken in as a stream of files."""
    return ingest.latest_of_files(spark, f"{d}/oplog.parquet")


@_query("SELECT batch_no, key AS user_key, value FROM (SELECT batch_no, user_key AS key, value FROM batch WHERE op = 1 AND user_key IS NOT NULL AND value IS NOT NULL) GROUP BY ALL")
def json_batches(spark, d):
    """Puts as one JSON array of entries a batch, in order of key and value, and the arrays taken apart again."""
    text = _json_of_batches(_table(spark, d, "batch"))
    return text.select("batch_no", F.inline(F.from_json("json", "array<struct<user_key:string,value:string>>")))


def _json_of_batches(batch: DataFrame) -> DataFrame:
    """One row a batch: batch_no, json. Repeated puts stand once, several values of a key as several entries."""
    puts = batch.where("op = 1 AND user_key IS NOT NULL AND value IS NOT NULL")
    entries = F.array_sort(F.collect_set(F.struct("user_key", "value")))
    return puts.groupBy("batch_no").agg(F.to_json(entries).alias("json"))


def _loaded(spark, d) -> Store:
    store = Store(spark, scratch(spark, "store"), Options(create_if_missing=True))
    store.load(_log(spark, d), order=[F.col("seq"), F.col("user_key")])
    return store


def _text(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("user_key").cast("string").alias("user_key"), F.col("value").cast("string").alias("value"))


@_query(f"SELECT user_key, value FROM {_live()}")
def store_scan(spark, d):
    """The op-log bulk-loaded into a store, compacted down, and scanned."""
    with _loaded(spark, d) as store:
        store.compact_range()
        return _text(store.scan())


@_query(f"SELECT user_key, value FROM {_live()} WHERE user_key >= '{LO}' AND user_key < '{HI}'")
def store_range_after_deletes(spark, d):
    """A snapshot of the loaded store, read after every key of the range was deleted and compacted."""
    with _loaded(spark, d) as store:
        snapshot = store.snapshot()
        gone = store.range(LO.encode(), HI.encode()).select("user_key", F.lit(0).alias("op"), F.lit(None).cast("binary").alias("value"))
        store.load(gone, order=[F.col("user_key")])
        store.compact_range()
        return _text(store.range(LO.encode(), HI.encode(), snapshot))


@_query(f"SELECT CAST(range AS INTEGER) AS level, CASE WHEN range = 1 THEN (SELECT count(*) FROM {_live()}) ELSE 0 END AS n_rows FROM range(7)")
def store_statistics(spark, d):
    """Rows of each level of a store written in two parts, compacted and reopened: one live row a key, a level down."""
    store, snapshot = _in_parts(spark, d)
    with store:
        store.release(snapshot)
        store.compact_range()
    with Store(spark, store.path) as store:
        return store.statistics().select("level", "n_rows")


@_query(None)
def store_level_statistics(spark, d):
    """The whole statistics of the loaded and compacted store; its bytes and seconds are measured, so it has no SQL."""
    with _loaded(spark, d) as store:
        store.compact_range()
        return store.statistics()


def _in_parts(spark, d) -> tuple[Store, Snapshot]:
    """A store whose files hold the first half of the log, compacted, and its bulk logs the second; a snapshot between them."""
    log = _log(spark, d)
    half, by = _half(_feed(spark, d)), [F.col("seq"), F.col("user_key")]
    store = Store(spark, scratch(spark, "store"), Options(create_if_missing=True))
    store.load(log.where(F.col("seq") <= half), order=by)
    snapshot = store.snapshot()
    store.compact_range()
    store.append(log.where(F.col("seq") > half), order=by)
    return store, snapshot


_ASKED = "SELECT a.user_key, l.user_key IS NOT NULL AS found, l.value FROM (SELECT DISTINCT user_key FROM probes WHERE user_key IS NOT NULL) a LEFT JOIN {live} l USING (user_key)"


def _asked(spark, d, store: Store, snapshot: Snapshot | None = None) -> DataFrame:
    got = store.multi_get(_table(spark, d, "probes"), snapshot)
    return got.select(F.col("user_key").cast("string").alias("user_key"), "found", F.col("value").cast("string").alias("value"))


@_query(_ASKED.format(live=_live()))
def store_get_newest(spark, d):
    """All keys of the probes asked of a store with rows in files and in logs not yet flushed."""
    with _in_parts(spark, d)[0] as store:
        return _asked(spark, d, store)


@_query(_ASKED.format(live=_live(f"seq <= {_HALF}")))
def store_get_at_snapshot(spark, d):
    """The same keys at a snapshot taken before the second half of the log was written, flushed and compacted."""
    store, snapshot = _in_parts(spark, d)
    with store:
        store.compact_range()
        return _asked(spark, d, store, snapshot)


@_query(f"SELECT user_key, value FROM {_live(f'seq <= {_HALF}')}")
def store_scan_before_compaction(spark, d):
    """A scan handed out at a snapshot, read after the files it reads were compacted away."""
    store, snapshot = _in_parts(spark, d)
    with store:
        rows = _text(store.scan(snapshot))
        store.compact_range()
        return rows


@_query(f"SELECT user_key, value FROM {_live()}")
def store_recovered(spark, d):
    """The log written to a store's logs only, and the store opened again: the logs are replayed."""
    store, _ = _in_parts(spark, d)
    store.close()
    with Store(spark, store.path) as store:
        return _text(store.scan())


@_query(f"SELECT user_key, value FROM {_live()} WHERE starts_with(user_key, '{PREFIX}')")
def store_flushed_prefix(spark, d):
    """A prefix read after logs were recovered, flushed to files, and the store opened once more."""
    store, _ = _in_parts(spark, d)
    store.close()
    with Store(spark, store.path) as store:
        store.flush()
    with Store(spark, store.path) as store:
        return _text(store.prefix(PREFIX.encode()))


@_query("""SELECT user_key, coalesce(value, '') AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY batch_no DESC, ordinal DESC, op DESC, value DESC NULLS LAST) AS rn
  FROM (SELECT DISTINCT * FROM batch) WHERE user_key IS NOT NULL AND op IN (0, 1) AND batch_no IS NOT NULL) WHERE rn = 1 AND op = 1""")
def store_batches(spark, d):
    """Every batch applied at once, one after the other, through the queue of writers; their rows stream through the driver."""
    rows = _table(spark, d, "batch").where("user_key IS NOT NULL AND op IN (0, 1) AND batch_no IS NOT NULL").distinct()
    rows = rows.orderBy("batch_no", "ordinal", "op", F.asc_nulls_first("value"))

    def batches():
        of, batch = None, Batch()
        for r in rows.toLocalIterator():
            if r.batch_no != of:
                yield batch
                of, batch = r.batch_no, Batch()
            batch.put(r.user_key.encode(), (r.value or "").encode()) if r.op else batch.delete(r.user_key.encode())
        yield batch

    with Store(spark, scratch(spark, "store"), Options(create_if_missing=True)) as store:
        store.apply_all(batches())
        return _text(store.scan())


@_query(f"""SELECT a.user_key, l.seq, l.op, CASE WHEN l.op = 1 THEN coalesce(l.value, '') END AS value FROM (SELECT DISTINCT user_key FROM probes WHERE user_key IS NOT NULL) a
  JOIN (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC, op DESC, value DESC NULLS LAST) AS rn FROM {_LOG} WHERE seq <= {_HALF}) l USING (user_key) WHERE rn = 1""")
def table_get(spark, d):
    """All keys of the probes asked of the op-log's table files, through index and filters, at half of the log."""
    folder = scratch(spark, "tables")
    connectors.write_tables(_log(spark, d), folder).collect()
    snapshot = _feed(spark, d).agg(F.expr("max(seq) div 2")).first()[0]
    got = connectors.lookup_tables(spark, folder, _table(spark, d, "probes").select(F.col("user_key").cast("binary").alias("key")), snapshot or 0)
    return got.select(F.col("key").cast("string").alias("user_key"), "seq", "op", F.col("value").cast("string").alias("value"))
