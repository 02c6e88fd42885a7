"""Run a registered query and its SQL counterpart, and compare the rows without order."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else repr(v + 0.0)
    return "null" if v is None else (str(v) if not isinstance(v, int) or isinstance(v, bool) else repr(v))


def _kind(v) -> type:
    return type(v)


def rows_of(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> list[str]:
    """Empty when both sides agree in columns, row count and values."""
    relation = con.sql(sql)
    want = rows_of(relation.columns, relation.fetchall())
    have = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if have[0] != want[0]:
        return [f"columns {have[0]} against {want[0]}"]
    if len(have[1]) != len(want[1]):
        return [f"{len(have[1])} rows against {len(want[1])}"]
    return [f"{a} against {b}" for a, b in zip(have[1], want[1]) if a != b]
