"""Runs a query and its SQL twin over one folder and compares types and values."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "int": "INTEGER"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if hasattr(x, "replace") and hasattr(x, "tzinfo"):
        return x.replace(tzinfo=None).isoformat()
    return repr(x)


def compare(con, df, sql: str) -> str:
    """Empty if equal, else what differs."""
    cols = sorted(df.columns)
    kinds = dict(df.dtypes)
    got = sorted(tuple(_cell(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} and {sorted(rel.columns)}"
    theirs = dict(zip(rel.columns, map(str, rel.types), strict=True))
    at = [rel.columns.index(c) for c in cols]
    want = sorted(tuple(_cell(r[k]) for k in at) for r in rel.fetchall())
    odd = [f"{c}: {kinds[c]} and {theirs[c]}" for c in cols if TYPES.get(kinds[c]) != theirs[c] and theirs[c] != '"NULL"']
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    if got != want:
        a, b = next((x, y) for x, y in zip(got, want, strict=True) if x != y)
        return f"rows differ: {str(a)[:600]} and {str(b)[:600]}"
    return "; ".join(odd)
