"""Run catalogue queries against their SQL on DuckDB: python tests/compare.py SF [name ...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None:
        return "<null>"
    if v != v:
        return "nan"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v + 0.0 if v else 0.0)
    return str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def check(spark, con, sf_dir, q):
    """(ok, message) for one query."""
    t0 = time.time()
    df = q.run(spark, sf_dir)
    cols, rows = canonical(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if q.sql is None:
        return len(rows) > 0, f"rows only: {len(rows)} rows, {t1 - t0:.1f}s"
    cur = con.execute(q.sql)
    ocols, orows = canonical([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    note = f"{len(rows)} rows, spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s"
    if cols != ocols:
        return False, f"columns {cols} != {ocols}"
    if rows != orows:
        a, b = set(rows) - set(orows), set(orows) - set(rows)
        return False, f"{note}; {len(rows)} vs {len(orows)} rows; spark only {sorted(a)[:3]}; sql only {sorted(b)[:3]}"
    return True, note if rows else note + " EMPTY"


if __name__ == "__main__":
    from wiretally.plans.catalog import QUERIES
    from wiretally.session import build_session

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    names = sys.argv[2:]
    picked = [q for n, q in QUERIES.items() if not names or any(n.startswith(x) for x in names)]
    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf_dir), 0
    for q in picked:
        try:
            ok, msg = check(spark, con, sf_dir, q)
        except Exception as ex:  # report and go on
            ok, msg = False, f"{type(ex).__name__}: {str(ex)[:900]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + q.name + ": " + msg, flush=True)
    print(f"{len(picked)} queries, {bad} failed")
