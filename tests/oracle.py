"""Rows of a Spark query against those of its SQL in DuckDB."""

from __future__ import annotations

import math
from collections import Counter
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, Decimal, float)):
        v = float(v)
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dict):
        return tuple(sorted((str(k), _plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if hasattr(v, "asDict"):
        return _plain(list(v))
    return str(v)


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def duck(folder: Path):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in sorted(folder.glob("*.parquet")):
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"create view {p.stem} as select * from read_parquet('{source}')")
    return con


def difference(spark_df, con, sql: str) -> str:
    """Empty if both give the same columns and rows."""
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(names)}"
    a, b = rows_of(spark_df.columns, spark_df.collect()), rows_of(names, got.fetchall())
    if a == b:
        return ""
    return f"{sum(a.values())} and {sum(b.values())} rows; Spark only: {list((a - b).items())[:4]}; SQL only: {list((b - a).items())[:4]}"
