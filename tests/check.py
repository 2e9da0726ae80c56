"""Run registered queries beside their SQL and compare rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.10g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_cell(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return _cell(v.asDict())
    return str(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted("|".join(_cell(r[k]) for k in order) for r in rows)


_KIND = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "array<string>": "VARCHAR[]", "array<double>": "DOUBLE[]", "array<int>": "INTEGER[]", "array<bigint>": "BIGINT[]",
    "float": "FLOAT", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP",
}


def compare(spark, con, name, fn, sql, sf_dir, allow_empty=False):
    """(ok, message)"""
    t0 = time.time()
    df = fn(spark, sf_dir)
    types = {c: _KIND.get(t, t) for c, t in df.dtypes}
    rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return len(rows) > 0, f"{name}: rows only {len(rows)} ({t1 - t0:.2f}s)"
    rel = con.sql(sql)
    sql_types = dict(zip(rel.columns, map(str, rel.types)))
    theirs = rel.fetchall()
    t2 = time.time()
    a, b = normal(df.columns, rows), normal(rel.columns, theirs)
    note = f"{name}: {len(rows)} vs {len(theirs)} rows ({t1 - t0:.2f}s / {t2 - t1:.2f}s)"
    if a[0] != b[0]:
        return False, f"{note} columns {a[0]} vs {b[0]}"
    drift = {c: (t, sql_types[c]) for c, t in types.items() if t != sql_types[c]}
    if drift:
        note += f" types {drift}"
    if not rows and not (allow_empty and not theirs):
        return False, note + " EMPTY"
    if a[1] != b[1]:
        left = [x for x in a[1] if x not in set(b[1])][:3]
        right = [x for x in b[1] if x not in set(a[1])][:3]
        return False, f"{note} DIFF {len(set(a[1]) ^ set(b[1]))}\n   ours   {left}\n   theirs {right}\n   cols {a[0]}"
    return not drift, note


def main():
    from lowtide.plans import ORACLES, QUERIES
    from lowtide.session import local_session

    sf_dir = sys.argv[1]
    names = sys.argv[2:] or list(QUERIES)
    names = [n for n in QUERIES if any(n == w or (w.endswith("*") and n.startswith(w[:-1])) for w in names)]
    if os.environ.get("PLAIN"):  # a session without the library's settings
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master("local[8]").getOrCreate()
    else:
        spark = local_session("8", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            ok, msg = compare(spark, con, n, QUERIES[n], ORACLES.get(n), sf_dir)
        except Exception as e:  # report and go on
            ok, msg = False, f"{n}: {type(e).__name__} {str(e)[:500]}"
        bad += not ok
        print("ok  " if ok else "BAD ", msg, flush=True)
    print(len(names), "queries", bad, "bad")


if __name__ == "__main__":
    main()
