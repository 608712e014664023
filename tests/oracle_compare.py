"""Comparison of a Spark result with its SQL twin, ignoring row order."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connection(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{root}/{table}.parquet'")
    return con


def as_rows(columns: list[str], rows) -> list[tuple]:
    """Rows as tuples over the columns in name order, sorted."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = (tuple(row[i] for i in order) for row in rows)
    return sorted(picked, key=lambda row: tuple((v is None, str(v)) for v in row))


def oracle_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    return sorted(columns), as_rows(columns, cursor.fetchall())


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), as_rows(df.columns, df.collect())
