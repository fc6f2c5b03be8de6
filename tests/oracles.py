"""Compares a query with its DuckDB SQL: same columns, same rows in any order."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return db


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0)
    if isinstance(x, (list, tuple)):
        return str([_cell(y) for y in x])
    return str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in data)


def compare(df, sql, sf_dir):
    """None if equal, or what differs."""
    cursor = connect(sf_dir).execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if got == want:
        return None
    a, b = set(got), set(want)
    return f"{len(got)} rows against {len(want)}; only here {sorted(a - b)[:3]}; only in SQL {sorted(b - a)[:3]}"
