"""Compare a Spark result with the SQL result over the same parquet tables."""

from __future__ import annotations

import glob
import math
import os
from decimal import Decimal

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, bool) or not isinstance(value, int):
        return repr(value)
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(df, connection, sql) -> str | None:
    """None if equal, else a short description."""
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = connection.execute(sql)
    want_columns, want = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    if got_columns != want_columns:
        return f"columns differ: {set(got_columns) ^ set(want_columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        cells = [(c, a, b) for c, a, b in zip(got_columns, g, w) if a != b]
        return f"{len(bad)} of {len(got)} rows differ, e.g. {cells[:4]}"
    return None
