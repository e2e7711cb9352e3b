"""Rows of a Spark query and of its SQL in DuckDB, brought to one form."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def plain(v) -> str:
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, Decimal)):
        return f"{float(v):.6f}"
    return str(v)


def spark_rows(df) -> tuple[list[str], list[tuple[str, ...]]]:
    names = sorted(df.columns)
    return names, sorted(tuple(plain(r[n]) for n in names) for r in df.collect())


def duck_rows(c, sql: str) -> tuple[list[str], list[tuple[str, ...]]]:
    q = c.sql(sql)
    at = {n: i for i, n in enumerate(q.columns)}
    names = sorted(at)
    return names, sorted(tuple(plain(r[at[n]]) for n in names) for r in q.fetchall())
