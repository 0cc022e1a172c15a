"""Cut values for a score column and the flags they give."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddrows.functions.schema import quoted
from oddrows.operators.ranks import kth_largest, quantiles

STRATEGIES = ("adaptive_gap", "percentile", "expected_contamination", "top_k", "mean_std")
MIN_GAP = 0.08
TOP_SHARE = 0.20
GAP_BINS = 256  # a bin is far narrower than MIN_GAP, so every gap that counts spans bins


def threshold(
    df: DataFrame,
    score: str,
    strategy: str = "adaptive_gap",
    *,
    percentile: float = 95.0,
    std_multiplier: float = 1.5,
    expected_contamination: float | None = None,
    top_k: int | None = None,
    rows: int | None = None,
) -> float:
    """Cut value of the strategy; rows with a higher score are anomalous."""
    value = quoted(score)
    if strategy in ("percentile", "expected_contamination", "top_k") and rows is None:
        rows = df.count()

    def at(p: float, n: int) -> float:
        return quantiles(df, {"s": value}, [p / 100.0], rows=n)["s"][0]

    if strategy == "percentile":
        return at(percentile, rows)
    if strategy == "expected_contamination":
        share = 0.05 if expected_contamination is None else float(expected_contamination)
        share = min(max(share, 1.0 / max(rows, 1)), 0.5)
        return math.nextafter(at(100.0 * (1.0 - share), rows), -math.inf)
    if strategy == "top_k":
        k = 1 if top_k is None else max(1, min(int(top_k), rows))
        return math.nextafter(kth_largest(df, value, k, rows), -math.inf)
    if strategy == "adaptive_gap":
        return _adaptive_gap(df, score, percentile, at)
    row = df.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s")).first()
    return row["m"] + (std_multiplier if strategy == "mean_std" else 1.5) * row["s"]


def _adaptive_gap(df: DataFrame, score: str, percentile: float, at) -> float:
    """Midpoint of the widest gap among the top scores when it spans 8% of the range.

    A gap that wide always separates two equal-width bins, so minimum, maximum and count per
    bin decide it exactly: no score is sorted or shuffled.
    """
    value = quoted(score)
    ends = df.agg(F.count(value).alias("n"), F.min(value).alias("a"), F.max(value).alias("b")).first()
    n, low, high = ends["n"], ends["a"], ends["b"]
    if n < 4 or high - low < 1e-8:
        return at(percentile, n)
    span = high - low
    index = F.least(F.lit(GAP_BINS - 1), F.floor((value - F.lit(low)) / F.lit(span) * GAP_BINS))
    bins = df.groupBy(index.alias("bin")).agg(F.min(value).alias("a"), F.max(value).alias("b"), F.count(value).alias("c"))
    limit = max(1, min(math.ceil(n * TOP_SHARE), n - 1))
    best_gap, best, above = -1.0, None, 0
    found = sorted((r for r in bins.collect() if r["c"]), key=lambda r: -r["bin"])
    for upper, lower in zip(found, found[1:]):
        above += upper["c"]
        if above > limit:
            break
        gap = (upper["a"] - lower["b"]) / span
        if gap > best_gap:
            best_gap, best = gap, (upper["a"] + lower["b"]) / 2.0
    return best if best_gap >= MIN_GAP else at(percentile, n)


def flag(df: DataFrame, score: str, cut: float, name: str = "is_anomaly") -> DataFrame:
    return df.withColumn(name, (quoted(score) > F.lit(cut)).cast("int"))
