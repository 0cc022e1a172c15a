"""Imputation, scaling and PCA; fitted values are returned, never shared."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddrows.functions.schema import feature_columns, finite, number, quoted
from oddrows.operators.ranks import quantiles

PCA_MIN_COLUMNS = 25
PCA_MIN_ROWS = 100
PCA_SHARE = 0.95


@dataclass
class Prepared:
    """Key columns plus the feature matrix ``x0..``, and what was fitted."""

    df: DataFrame
    key: list[str]
    features: list[str]
    rows: int
    info: dict


def impute_medians(df: DataFrame, cols: list[str], rows: int) -> dict[str, float | None]:
    return {c: q[0] for c, q in quantiles(df, {c: number(c) for c in cols}, [0.5], rows=rows).items()}


def imputed(df: DataFrame, cols: list[str]) -> DataFrame:
    """Nulls replaced by the exact column median; an all-null column is dropped."""
    medians = impute_medians(df, cols, df.count())
    out = df.drop(*[c for c in cols if medians[c] is None])
    return out.withColumns({c: F.coalesce(number(c), F.lit(m)) for c, m in medians.items() if m is not None})


def robust_fit(df: DataFrame, exprs: dict[str, Column], rows: int) -> dict[str, tuple[float, float]]:
    """(median, interquartile range or 1) per column."""
    q = quantiles(df, exprs, [0.25, 0.5, 0.75], rows=rows)
    return {c: (m, (b - a) or 1.0) for c, (a, m, b) in q.items()}


def standard_fit(df: DataFrame, exprs: dict[str, Column]) -> dict[str, tuple[float, float]]:
    """(mean, population deviation or 1) per column."""
    names = list(exprs)
    row = df.agg(*[f(exprs[n]).alias(f"{t}{i}") for i, n in enumerate(names) for f, t in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
    return {n: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, n in enumerate(names)}


def scaled(df: DataFrame, cols: list[str], policy: str = "robust") -> DataFrame:
    exprs = {c: number(c) for c in cols}
    fit = robust_fit(df, exprs, df.count()) if policy == "robust" else standard_fit(df, exprs)
    return df.withColumns({c: (exprs[c] - F.lit(fit[c][0])) / F.lit(fit[c][1]) for c in cols})


def domain_matrix(df: DataFrame, cols: list[str], rows: int | None = None) -> dict[str, Column]:
    """Infinities and nulls replaced by the column median, else 0, as expressions."""
    rows = df.count() if rows is None else rows
    medians = quantiles(df, {c: finite(c) for c in cols}, [0.5], rows=rows)
    return {c: F.coalesce(finite(c), F.lit(medians[c][0] if medians[c][0] is not None else 0.0)) for c in cols}


def gram(df: DataFrame, cols: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, column means, centred cross-product matrix) from partition sums."""
    means = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(quoted(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    n, shift = means["n"], np.array([means[f"m{i}"] for i in range(len(cols))], dtype=float)
    upper = np.triu_indices(len(cols))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(cols), len(cols)))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - shift
            total += x.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), pa.array(total[upper])],
            names=["i", "j", "s"],
        )

    parts = df.select(*[quoted(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).mapInArrow(sums, "i int, j int, s double")
    out = np.zeros((len(cols), len(cols)))
    for r in parts.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["s"]
    return n, shift, out


def pca_components(covariance: np.ndarray, share: float = PCA_SHARE) -> np.ndarray:
    """Leading eigenvectors (as rows) whose variance share first exceeds ``share``."""
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order].T
    cumulative = np.cumsum(values) / max(values.sum(), 1e-300)
    count = min(len(values), int(np.searchsorted(cumulative, share, side="right")) + 1)
    lead = vectors[:count]
    signs = np.sign(lead[np.arange(count), np.abs(lead).argmax(axis=1)])
    return lead * np.where(signs == 0, 1.0, signs)[:, None]


def project(df: DataFrame, passed: list[str], cols: list[str], mean: np.ndarray, components: np.ndarray) -> DataFrame:
    """Passed columns plus ``x0..`` = (row - mean) times the components, by Arrow batch."""
    types = {f.name: f for f in df.schema.fields}
    schema = T.StructType([types[c] for c in passed] + [T.StructField(f"x{i}", T.DoubleType()) for i in range(len(components))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(len(passed) + i).to_numpy(zero_copy_only=False) for i in range(len(cols))])
            y = (x - mean) @ components.T
            arrays = [batch.column(i) for i in range(len(passed))] + [pa.array(y[:, j]) for j in range(y.shape[1])]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return df.select(*[quoted(c) for c in passed], *[quoted(c).cast("double").alias(f"__c{i}") for i, c in enumerate(cols)]).mapInArrow(run, schema)


def preprocess(
    df: DataFrame,
    key: list[str],
    *,
    exclude: list[str] | None = None,
    order_by: list[str] | None = None,
    scaler_policy: str = "robust",
    pca_policy: str = "auto",
    rows: int | None = None,
) -> Prepared:
    """Impute by median, scale, and reduce by PCA when the policy says so."""
    if scaler_policy not in ("robust", "standard"):
        raise ValueError("scaler_policy must be 'robust' or 'standard'")
    if pca_policy not in ("auto", "always", "never"):
        raise ValueError("pca_policy must be 'auto', 'always' or 'never'")
    kept, ignored = feature_columns(df, [*(exclude or []), *key])
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(number(c)).alias(f"c{i}") for i, c in enumerate(kept)]).first()
    rows = counts["n"]
    dropped = [c for i, c in enumerate(kept) if counts[f"c{i}"] == 0]
    holes = [c for i, c in enumerate(kept) if 0 < counts[f"c{i}"] < rows]
    used = [c for c in kept if c not in dropped]
    medians = impute_medians(df, holes, rows) if holes else {}
    exprs = {c: F.coalesce(number(c), F.lit(medians[c])) if c in holes else number(c) for c in used}
    fit = robust_fit(df, exprs, rows) if scaler_policy == "robust" else standard_fit(df, exprs)
    passed = list(dict.fromkeys([*key, *(order_by or [])]))
    out = df.select(
        *[quoted(k) for k in passed],
        *[((exprs[c] - F.lit(fit[c][0])) / F.lit(fit[c][1])).alias(f"x{i}") for i, c in enumerate(used)],
    )
    features = [f"x{i}" for i in range(len(used))]
    use_pca = pca_policy == "always" and len(used) > 1
    use_pca = use_pca or (pca_policy == "auto" and len(used) >= PCA_MIN_COLUMNS and rows >= PCA_MIN_ROWS)
    components = None
    if use_pca:
        _, mean, cross = gram(out, features)
        basis = pca_components(cross)
        out = project(out, passed, features, mean, basis)
        components = len(basis)
        features = [f"x{i}" for i in range(components)]
    info = {
        "feature_columns": kept, "ignored_columns": ignored, "dropped_columns": dropped,
        "imputation_strategy": "median", "scaler_policy": scaler_policy, "pca_policy": pca_policy,
        "pca_used": use_pca, "pca_components": components,
    }
    return Prepared(out, key, features, rows, info)
