"""Runs a query in Spark and its SQL in DuckDB and compares rows, columns and values."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb

DATA = Path(os.environ.get("TESTDATA", "/root/testdata"))


def connection(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted((DATA / sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v + 0.0:.9g}")
    return str(v) if hasattr(v, "isoformat") else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


def compare(spark, name, query, sql, sf="sf0.001"):
    """None if they agree, else what differs."""
    df = query(spark, str(DATA / sf))
    con = connection(sf)
    res = con.execute(sql)
    columns = [d[0] for d in res.description]
    want = res.fetchall()
    got = [tuple(r) for r in df.collect()]
    if sorted(columns) != sorted(df.columns):
        return f"{name}: columns {sorted(df.columns)} and {sorted(columns)}"
    a, b = rows(df.columns, got), rows(columns, want)
    if len(a) != len(b):
        return f"{name}: {len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{name}: {len(bad)} of {len(a)} rows differ, {bad[0]}" if bad else None
