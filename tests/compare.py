"""Runs queries in Spark and their SQL in DuckDB and compares the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for r in rows:
        out.append(tuple(_plain(r[i]) for i in order))
    return sorted(columns), sorted(out, key=repr)


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    if isinstance(x, (bytearray, memoryview)):
        return bytes(x)
    if isinstance(x, list):
        return tuple(_plain(y) for y in x)
    return x


def duck(d: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(d).glob("*.parquet")):
        glob = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{glob}')")
    return con


def compare(spark, d: str, f, sql: str, con=None):
    """None when equal, else what differs."""
    df = f(spark, d)
    got = rows_of(df.columns, df.collect())
    rel = (con or duck(d)).sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if got == want:
        return None
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    missing, extra = set(want[1]) - set(got[1]), set(got[1]) - set(want[1])
    return f"{len(got[1])} rows and {len(want[1])}; missing {list(missing)[:3]}; extra {list(extra)[:3]}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry

    from tidemark.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    d, names = sys.argv[1], sys.argv[2:]
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad, con = 0, duck(d)
    for name in names or queries:
        t = time.time()
        try:
            if name in sqls:
                said = compare(spark, d, queries[name], sqls[name], con)
                n = ""
            else:
                said, n = None, f"{queries[name](spark, d).count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:600]}"
        bad += said is not None
        print(f"{name}: {said or 'equal'} {n} ({time.time() - t:.1f} s)", flush=True)
    sys.exit(bool(bad))
