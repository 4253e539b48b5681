"""Runs a registered query and its SQL on the same folder and compares the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return ("nan",) if math.isnan(value) else (0.0 if value == 0 else value)
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat() if hasattr(value, "hour") else value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    found = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(found, key=repr)


def compare(df, con, sql) -> str | None:
    """None when equal, else a description of the first difference."""
    cur = con.execute(sql)
    want_types = {d[0]: str(d[1]) for d in cur.description}
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    names = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
             "TIMESTAMP": "timestamp", "INTEGER": "int"}
    for name, kind in df.dtypes:
        if names.get(want_types[name], kind) != kind:
            return f"type of {name}: {kind} != {want_types[name]}"
        if want_types[name] not in names:
            return f"type of {name}: {kind} against {want_types[name]}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for mine, theirs in zip(got, want):
        if mine != theirs:
            return f"{got_cols}\n  spark  {mine}\n  sql    {theirs}"
    return None if got else "no rows"
