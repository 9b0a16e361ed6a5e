"""Runs a registered query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    return value


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in data), key=_key)


def differences(df, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    columns = df.columns
    ours = rows_of(columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    theirs_columns = [d[0] for d in cur.description]
    theirs = rows_of(theirs_columns, cur.fetchall())
    if sorted(columns) != sorted(theirs_columns):
        return f"columns {sorted(columns)} vs {sorted(theirs_columns)}"
    if ours == theirs:
        return None
    a, b = [r for r in ours if r not in theirs][:3], [r for r in theirs if r not in ours][:3]
    return f"{len(ours)} vs {len(theirs)} rows; ours only {a}; theirs only {b}"
