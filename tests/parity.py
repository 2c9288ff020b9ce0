"""Spark query against its DuckDB statement: rows, columns and values."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (datetime, pd.Timestamp)):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, date):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, (bool, int)):
        return int(v)
    if isinstance(v, (float, Decimal)):
        return round(float(v), 9) + 0.0
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        return tuple(plain(x) for x in (v.tolist() if hasattr(v, "tolist") else v)) if not hasattr(v, "item") or getattr(v, "ndim", 0) else plain(v.item())
    return v


def rows_of(columns: list[str], rows: list) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def differences(spark_df, con, sql: str) -> list[str]:
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    out = []
    if sorted(spark_df.columns) != sorted(names):
        out.append(f"columns {sorted(spark_df.columns)} and {sorted(names)}")
    if len(got) != len(want):
        out.append(f"{len(got)} rows and {len(want)}")
    bad = [(a, b) for a, b in zip(got, want, strict=False) if a != b]
    if bad:
        out.append(f"{len(bad)} rows differ, first {bad[0]}")
    return out
