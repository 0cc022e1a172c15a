"""Queries over the given tables, one per operator, each with an independent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddrows.session import release

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, when given, the SQL it must agree with."""

    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        def fresh(spark: SparkSession, folder: str) -> DataFrame:
            release()  # frames kept by the query before; unpersisting only costs a recompute
            return run(spark, folder)

        QUERIES[name] = fresh
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded number without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def out(df: DataFrame, digits: int = 6, **coarse: int) -> DataFrame:
    """Every double column rounded; ``coarse`` gives other digits by column."""
    return df.select(*[
        rounded(f"`{n}`", coarse.get(n, digits)).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes
    ])


def stacked(source: str, cols: list[str]) -> str:
    """SQL: (column, v) rows of some columns of a table or subquery alias."""
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS v FROM {source}" for c in cols)


def sql_hash(seed: int | str, key: str, start: int = 1) -> str:
    """SQL: the 52-bit number cut from md5('seed:key')."""
    return f"CAST(CAST(('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), {start}, 13)) AS BIGINT) AS DOUBLE)"


def block_sql(n: str, k: str, blocks: int, seed: int) -> str:
    """SQL: (b, e), the first and the next position after each of ``blocks`` runs that hold ``k`` of ``n`` rows."""
    number = f"CAST(('0x' || substr(md5('{seed}:block:' || i), 1, 13)) AS HUGEINT)"
    return f"""(SELECT cut + before AS b, cut + before + size AS e FROM (
  SELECT cut, {k} // {blocks} + CASE WHEN j < {k} % {blocks} THEN 1 ELSE 0 END AS size, j * ({k} // {blocks}) + least(j, {k} % {blocks}) AS before
  FROM (SELECT CAST({number} * ({n} - {k} + 1) // 4503599627370496 AS BIGINT) AS cut, row_number() OVER (ORDER BY {number} * ({n} - {k} + 1) // 4503599627370496, i) - 1 AS j
        FROM range({blocks}) r(i))))"""


def load_all() -> None:
    from checks import (  # noqa: F401
        evaluate, explore, learn, ordered_work, perturb, prepare, score, study_tables,
    )
