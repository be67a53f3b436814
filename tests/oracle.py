"""Compares a query with its SQL in DuckDB over the same files, as multisets of rows with columns by name."""

from __future__ import annotations

import datetime
import decimal
from collections import Counter
from pathlib import Path

import duckdb


def plain(value):
    """One form for equal values of the two engines."""
    if isinstance(value, float):
        return float(f"{value:.12g}") + 0.0
    if isinstance(value, decimal.Decimal):
        return plain(float(value))
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def of_sql(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    return sorted(columns), rows_of(columns, found.fetchall())


def of_spark(df) -> tuple[list[str], Counter]:
    return sorted(df.columns), rows_of(df.columns, df.collect())


def differences(df, sql: str, sf_dir: str) -> list[str]:
    (a_columns, a), (b_columns, b) = of_spark(df), of_sql(sql, sf_dir)
    if a_columns != b_columns:
        return [f"columns {a_columns} and {b_columns}"]
    return [f"Spark only: {x}" for x in list((a - b))[:3]] + [f"SQL only: {x}" for x in list((b - a))[:3]]
