"""Run registered queries beside their SQL and compare whole results."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def as_set(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = [tuple(cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(data, key=lambda r: tuple((x is not None, str(type(x)) if x is None else "", repr(x)) for x in r))


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences found, empty when both sides hold the same rows."""
    got_cols, got = as_set(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = con.execute(sql)
    want_cols, want = as_set([c[0] for c in result.description], result.fetchall())
    if got_cols != want_cols:
        return [f"columns {got_cols} against {want_cols}"]
    problems = []
    if len(got) != len(want):
        problems.append(f"{len(got)} rows against {len(want)}")
    if got != want:
        extra, missing = list(set(map(repr, got)) - set(map(repr, want))), list(set(map(repr, want)) - set(map(repr, got)))
        if extra or missing or len(got) != len(want):
            problems.append(f"{len(extra)} rows differ; got {sorted(extra)[:3]}; want {sorted(missing)[:3]}")
    return problems
