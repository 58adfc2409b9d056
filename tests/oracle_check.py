"""Compare a Spark result with DuckDB's: columns, row count and values."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return con


def _value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return x


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def difference(con, df, sql) -> str | None:
    """None if equal, else what differs."""
    result = con.execute(sql)
    kinds, expected = [(d[0], str(d[1])) for d in result.description], result.fetchall()
    names = [name for name, _ in kinds]
    mine = [(name, KINDS.get(kind, kind)) for name, kind in df.dtypes]
    if sorted(kinds) != sorted(mine):
        return f"schema {sorted(mine)}, expected {sorted(kinds)}"
    got = [tuple(row) for row in df.collect()]
    if len(got) != len(expected):
        return f"{len(got)} rows, expected {len(expected)}"
    a, b = _rows(df.columns, got), _rows(names, expected)
    if a != b:
        return f"{sum((a - b).values())} rows differ, e.g. {list((a - b).items())[:2]} expected {list((b - a).items())[:2]}"
    return None
