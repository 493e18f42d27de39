"""Compare a query with its SQL on the same tables, order and float noise aside."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def value(v) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool) or isinstance(v, str):
        return str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    try:
        return f"{float(v):.6g}"
    except (TypeError, ValueError):
        return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def expected(sf: str, sql: str):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    out = con.sql(sql)
    return sorted(out.columns), rows_of(out.columns, out.fetchall())


def actual(df):
    return sorted(df.columns), rows_of(df.columns, df.collect())
