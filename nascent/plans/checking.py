"""Run registered queries next to their check statements and compare the results."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_plain(v) for v in value) + "]"
    return f"{type(value).__name__}:{value}"


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(df, con, sql: str) -> list[str]:
    """Empty when both results hold the same columns and the same rows."""
    result = con.execute(sql)
    expected_columns = [c[0] for c in result.description]
    expected = _rows(expected_columns, result.fetchall())
    actual = _rows(df.columns, [tuple(r) for r in df.collect()])
    found = []
    if sorted(df.columns) != sorted(expected_columns):
        found.append(f"columns {sorted(df.columns)} != {sorted(expected_columns)}")
    if len(actual) != len(expected):
        found.append(f"rows {len(actual)} != {len(expected)}")
    if actual != expected:
        only_here = sorted(set(actual) - set(expected))[:3]
        only_there = sorted(set(expected) - set(actual))[:3]
        found.append(f"here {only_here} there {only_there}")
    return found
