"""Run queries and their SQL side by side: python tests/oracle.py [sf] [name ...]

With FRONTGAUGE_TIGHT=1 all size limits are so low that every group is treated
as too big for one task and every table as too big to broadcast.
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = "/root/testdata"
NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


TIGHT = {"window.rows": 40, "compare.rows": 30, "broadcast.rows": 20, "site.rows": 8, "sweep.rows": 30}


def tighten(spark):
    for k, v in TIGHT.items():
        spark.conf.set(f"frontgauge.{k}", str(v))


def connect(sf: str):
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{DATA}/sf{sf}/{n}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return (1, str(v))
    return (2, float(v))


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted([tuple(_cell(r[i]) for i in order) for r in rows])


def close(a, b, tol):
    if a[0] != b[0]:
        return False
    if a[0] != 2:
        return a == b
    return a[1] == b[1] or math.isclose(a[1], b[1], rel_tol=tol, abs_tol=tol)


def compare(spark, con, name, run, sql, sf, tol=0.0):
    """None if equal, else what differs. tol=0 asks for identical rounded values."""
    df = run(spark, f"{DATA}/sf{sf}")
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} against {sorted(cols)}"
    if len(got) != len(want):
        return f"rows {len(got)} against {len(want)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    for x, y in zip(a, b):
        if not all(close(p, q, tol) for p, q in zip(x, y)):
            return f"{x} against {y}"
    return None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries

    from frontgauge.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    spark = build_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("FRONTGAUGE_TIGHT"):
        tighten(spark)
    con, sqls = connect(sf), oracle_sql()
    bad = 0
    for name, run in queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            if name not in sqls:
                rows = run(spark, f"{DATA}/sf{sf}").count()
                print(f"rows {name} {time.time() - t:.1f}s no SQL, {rows} rows", flush=True)
                continue
            msg = compare(spark, con, name, run, sqls[name], sf)
        except Exception as e:  # noqa: BLE001
            msg = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += msg is not None
        print(f"{'ok  ' if msg is None else 'BAD '} {name} {time.time() - t:.1f}s {msg or ''}", flush=True)
    print("bad:", bad)
