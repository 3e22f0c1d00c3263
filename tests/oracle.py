"""Runs a query and its SQL twin on the same tables and compares every value."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value: object) -> object:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "asDict"):
        return _plain(value.asDict())
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in sorted(value.items())}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, float):
        return round(value, 9) + 0.0
    return value


def _rows(names: list[str], rows: list) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([_plain(r[i]) for i in order]) for r in rows)


_SQL_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "float": "FLOAT"}


def type_differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Columns whose types are not the same on both sides."""
    rel = con.sql(sql)
    theirs = dict(zip(rel.columns, map(str, rel.types)))
    ours = {f.name: _SQL_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    return [f"{c} {ours[c]} / {theirs[c]}" for c in ours if c in theirs and ours[c] != theirs[c] and theirs[c] != '"NULL"']


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both agree, else a short description of the difference."""
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    ours, theirs = df.collect(), rel.fetchall()
    a, b = _rows(df.columns, ours), _rows(rel.columns, theirs)
    if len(a) != len(b):
        return f"{len(a)} rows, SQL has {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first:\n  spark {bad[0][0][:600]}\n  sql   {bad[0][1][:600]}"
    return None
