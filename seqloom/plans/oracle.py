"""Comparison of query results with DuckDB's on the same Parquet tables."""

from __future__ import annotations

import math
import os


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(folder):
        if file.endswith(".parquet"):
            inside = "/*.parquet" if os.path.isdir(f"{folder}/{file}") else ""
            con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{file}{inside}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    """Rows as tuples in the order of column names, sorted."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, query, sql: str, folder: str) -> tuple[list[str], list[tuple], list[str], list[tuple]]:
    df, rel = query(spark, folder), con.sql(sql)
    return sorted(df.columns), rows_of(df.columns, df.collect()), sorted(rel.columns), rows_of(rel.columns, rel.fetchall())
