"""Compare registered queries with their reference SQL in DuckDB.

Usage: python tests/oracle.py [sf] [name prefix ...]
"""
from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
from pyspark.sql import SparkSession

RAW = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
       "labels conversations").split()


def session() -> SparkSession:
    return (SparkSession.builder.master("local[8]").appName("oracle")
            .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
            .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
            .config("spark.log.level", "ERROR").config("spark.ui.showConsoleProgress", "false").getOrCreate())


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in RAW:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    return v


def rows_of(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return f"columns {sorted(set(df.columns) ^ set(want_cols))}"
    a, b = rows_of(df.columns, got), rows_of(want_cols, want)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    cols = sorted(want_cols)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        x, y = bad[0]
        diff = {c: (p, q) for c, p, q in zip(cols, x, y) if p != q}
        return f"{len(bad)}/{len(a)} rows differ, first: {diff}"
    types = {c: (type(p).__name__, type(q).__name__) for x, y in zip(a, b) for c, p, q in zip(cols, x, y)
             if p is not None and type(p) is not type(q)}
    return f"types {types}" if types else None


if __name__ == "__main__":
    import __spark_entry__ as E
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    pre = tuple(sys.argv[2:])
    spark, con, sf_dir = session(), duck(f"/root/testdata/sf{sf}"), f"/root/testdata/sf{sf}"
    qs, os_ = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if pre and not name.startswith(pre):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            res = compare(df, con, os_[name]) if name in os_ else f"(no sql) rows {df.count()}"
        except Exception as e:  # noqa: BLE001
            res = "ERROR " + str(e)[:int(os.environ.get("ERRLEN", "600"))]
        if res and not res.startswith("(no sql)"):
            bad += 1
        print(f"{name:45s} {time.time() - t0:6.2f}s {res or 'ok'}", flush=True)
    print("failures:", bad)
