"""Dataset profile: missing values, moments, zeros, correlation, entropy."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from oddrows.functions.schema import number, numeric_columns

WIDE_LIMIT = 24  # columns up to which every pair is its own corr() aggregate
HIGH_CORRELATION = 0.85


def sample_skewness(c: Column) -> Column:
    """Bias-corrected skewness; null below 3 values, 0 for a constant column."""
    n = F.count(c).cast("double")
    value = F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n < 3, F.lit(None)).when(F.max(c) == F.min(c), F.lit(0.0)).otherwise(value)


def sample_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis; null below 4 values, 0 for a constant column."""
    n = F.count(c).cast("double")
    value = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6)
    return F.when(n < 4, F.lit(None)).when(F.max(c) == F.min(c), F.lit(0.0)).otherwise(value)


@dataclass
class Profile:
    """Bounded summary of a table: one entry per column, never per row."""

    samples: int
    features: int
    missing_rate: float
    variance_mean: float
    skewness_mean_abs: float
    kurtosis_mean_abs: float
    sparsity_zero_rate: float
    correlation_abs_mean: float
    high_corr_pair_count: int
    columns: list[dict] = field(default_factory=list)

    def frame(self, spark) -> DataFrame:
        flat = {k: v for k, v in asdict(self).items() if k != "columns"}
        return spark.createDataFrame([tuple(flat.values())], list(flat))

    def column_frame(self, spark) -> DataFrame:
        schema = (
            "column string, missing_rate double, variance double, skewness double, "
            "kurtosis double, zero_rate double, entropy double"
        )
        names = ["column", "missing_rate", "variance", "skewness", "kurtosis", "zero_rate", "entropy"]
        return spark.createDataFrame([tuple(c[k] for k in names) for c in self.columns], schema)


def column_moments(df: DataFrame, cols: list[str], extra: list[Column] | None = None) -> tuple[int, list[dict], Row]:
    """(rows, per-column count/missing/moments, extra aggregates) from one aggregate."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(cols):
        x = number(c)
        aggs += [
            F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}"),
            sample_skewness(x).alias(f"s{i}"), sample_kurtosis(x).alias(f"k{i}"),
            F.count_if(F.coalesce(x, F.lit(0.0)) == 0.0).alias(f"z{i}"),
            F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}"),
        ]
    r = df.agg(*aggs, *(extra or [])).first()
    rows = r["rows"]
    out = []
    for i, c in enumerate(cols):
        out.append({
            "column": c, "count": r[f"n{i}"], "missing_rate": (rows - r[f"n{i}"]) / rows if rows else 0.0,
            "mean": r[f"m{i}"], "variance": r[f"v{i}"], "skewness": _finite(r[f"s{i}"]),
            "kurtosis": _finite(r[f"k{i}"]), "zero_rate": r[f"z{i}"] / rows if rows else 0.0,
            "min": r[f"a{i}"], "max": r[f"b{i}"],
        })
    return rows, out, r


def _finite(x: float | None) -> float | None:
    return x if x is not None and math.isfinite(x) else None


def binned_entropy(df: DataFrame, moments: list[dict]) -> dict[str, float]:
    """Shannon entropy in bits over equal-width right-closed bins, one aggregate.

    Cumulative counts at the inner edges are enough, so no row is shuffled.
    """
    plans, aggs = {}, []
    for i, m in enumerate(moments):
        if m["count"] == 0 or m["min"] == m["max"]:
            continue
        bins = min(10, max(2, math.isqrt(m["count"])))
        width = (m["max"] - m["min"]) / bins
        edges = [m["min"] + j * width for j in range(1, bins)]
        plans[i] = (bins, m["count"])
        aggs += [F.count_if(number(m["column"]) <= F.lit(e)).alias(f"e{i}_{j}") for j, e in enumerate(edges)]
    out = {m["column"]: 0.0 for m in moments}
    if not aggs:
        return out
    row = df.agg(*aggs).first()
    for i, (bins, n) in plans.items():
        cumulative = [0, *[row[f"e{i}_{j}"] for j in range(bins - 1)], n]
        p = np.diff(np.array(cumulative, dtype=float)) / n
        out[moments[i]["column"]] = float(-(p * np.log2(np.maximum(p, 1e-12))).sum())
    return out


def _pair_aggregates(cols: list[str]) -> list[Column]:
    x = [number(c) for c in cols]
    aggs = []
    for a, b in combinations(range(len(cols)), 2):
        both = x[a].isNotNull() & x[b].isNotNull()
        u, v = F.when(both, x[a]), F.when(both, x[b])
        # (Not ``corr``: it divides by zero, which is an error in ANSI mode, where a column is constant.)
        aggs.append((F.covar_pop(u, v) / F.nullif(F.stddev_pop(u) * F.stddev_pop(v), F.lit(0.0))).alias(f"r{a}_{b}"))
    return aggs


def pairwise_correlations(df: DataFrame, cols: list[str], wide_limit: int = WIDE_LIMIT) -> DataFrame:
    """Pearson r of every column pair over the rows complete in that pair: (a, b, r)."""
    spark = df.sparkSession
    pairs = list(combinations(range(len(cols)), 2))
    if not pairs:
        return spark.createDataFrame([], "a string, b string, r double")
    if len(cols) <= wide_limit:
        row = df.agg(*_pair_aggregates(cols)).first()
        rows = [(cols[a], cols[b], _finite(row[f"r{a}_{b}"])) for a, b in pairs]
        return spark.createDataFrame(rows, "a string, b string, r double")
    return _gram_correlations(df, cols)


def _gram_correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Many columns: masked cross-product sums per Arrow batch, added up per pair."""
    means = df.agg(*[F.avg(number(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    shift = np.array([m if m is not None else 0.0 for m in means])  # centring keeps the digits
    upper = np.triu_indices(len(cols), 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            mask = ~np.isnan(x)
            x = np.where(mask, x - shift, 0.0)
            m = mask.astype(float)
            part = np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
            total = part if total is None else total + part
        if total is not None:
            values = [pa.array(total[s][upper]) for s in range(6)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), *values],
                names=["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"],
            )

    schema = "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"
    parts = df.select(*[number(c).alias(f"c{i}") for i, c in enumerate(cols)]).mapInArrow(sums, schema)
    s = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    var = (F.col("sxx") - F.col("sx") ** 2 / F.col("n")) * (F.col("syy") - F.col("sy") ** 2 / F.col("n"))
    names = F.array(*[F.lit(c) for c in cols])
    r = F.when((F.col("n") > 0) & (var > 0), cov / F.sqrt(var))
    return s.select(names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), r.alias("r"))


def analyze(df: DataFrame, cols: list[str] | None = None) -> Profile:
    """Full profile of the numeric columns: two aggregates over the table."""
    cols = cols or numeric_columns(df)
    if not cols:
        raise ValueError("at least one numeric column is required")
    narrow = len(cols) <= WIDE_LIMIT
    rows, moments, row = column_moments(df, cols, _pair_aggregates(cols) if narrow else None)
    entropy = binned_entropy(df, moments)
    if narrow:
        absolute = [abs(_finite(row[f"r{a}_{b}"]) or 0.0) for a, b in combinations(range(len(cols)), 2)]
        corr_mean, corr_high = (sum(absolute) / len(absolute) if absolute else 0.0), sum(r >= HIGH_CORRELATION for r in absolute)
    else:
        size = F.coalesce(F.abs(F.nanvl("r", F.lit(0.0))), F.lit(0.0))
        c = pairwise_correlations(df, cols).agg(F.avg(size).alias("m"), F.count_if(size >= HIGH_CORRELATION).alias("h")).first()
        corr_mean, corr_high = c["m"], c["h"]

    def mean(values: list) -> float:
        kept = [v for v in values if v is not None]
        return float(sum(kept) / len(kept)) if kept else 0.0

    columns = [
        {**m, "skewness": m["skewness"] or 0.0, "kurtosis": m["kurtosis"] or 0.0, "entropy": entropy[m["column"]]}
        for m in moments
    ]
    return Profile(
        samples=rows, features=len(cols),
        missing_rate=mean([m["missing_rate"] for m in moments]),
        variance_mean=mean([m["variance"] for m in moments]),
        skewness_mean_abs=mean([None if m["skewness"] is None else abs(m["skewness"]) for m in moments]),
        kurtosis_mean_abs=mean([None if m["kurtosis"] is None else abs(m["kurtosis"]) for m in moments]),
        sparsity_zero_rate=mean([m["zero_rate"] for m in moments]),
        correlation_abs_mean=float(corr_mean), high_corr_pair_count=int(corr_high),
        columns=columns,
    )
