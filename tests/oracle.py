"""Compare a query with its SQL: column names, row count and values, whatever the order."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*' if os.path.isdir(path) else ''}'")
    return con


def rows(names: list[str], values: list) -> list:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr(tuple(float(r[k]) + 0.0 if isinstance(r[k], float) else r[k] for k in order)) for r in values)


def differs(spark, con: duckdb.DuckDBPyConnection, query, sql: str, folder: str) -> str:
    """What differs, or nothing."""
    df = query(spark, folder)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} and {names}"
    a, b = rows(df.columns, got), rows(names, want)
    if a != b:
        return f"{len(a)} and {len(b)} rows; {sorted(set(a) - set(b))[:2]} and {sorted(set(b) - set(a))[:2]}; {df.dtypes}"
    return ""
