"""Run registered queries against their DuckDB text and compare values exactly."""

from __future__ import annotations

import datetime as dt
import math
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def check(spark, con, name, run, sql, sf_dir):
    t0 = time.time()
    df = run(spark, sf_dir)
    rows = df.collect()
    took = time.time() - t0
    got, cols = rows_of(df.columns, rows)
    if sql is None:
        return "rows-only" if rows else "EMPTY", took, f"{len(rows)} rows"
    t0 = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want, wcols = rows_of(names, cur.fetchall())
    duck = time.time() - t0
    note = f"{len(rows)} rows, duckdb {duck:.2f}s"
    if cols != wcols:
        return "COLUMNS", took, f"{sorted(set(cols) ^ set(wcols))}"
    if got != want:
        a, b = set(got), set(want)
        only_a, only_b = sorted(a - b)[:2], sorted(b - a)[:2]
        diff = ""
        if only_a and only_b:
            diff = [(c, x, y) for c, x, y in zip(cols, only_a[0], only_b[0]) if x != y]
        return "DIFF", took, f"{note}; want {len(want)} rows; {len(a - b)} differ {diff}\n   spark {only_a[:1]}\n   duck  {only_b[:1]}"
    return ("ok" if rows else "ok-EMPTY"), took, note
