"""Score normalisation, weights, gates and the weighted combination."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddrows.functions.schema import quoted
from oddrows.operators.ranks import quantiles, quantiles_with

# Prior weights of the score sources.
BASE_WEIGHTS = {
    "iforest": 0.45, "lof": 0.45, "ocsvm": 0.04, "autoencoder": 0.20, "lstm": 0.15,
    "knn_distance": 0.12, "temporal_change": 0.06, "flatline": 0.65, "freeze": 0.55,
}
OTHER_WEIGHT = 0.10
MIN_VARIANCE = 0.05
FLATLINE_DAMPING = 0.55
FLATLINE_GATE = 0.80
TEMPORAL_MIN_ROWS = 12
FREEZE_GATE = 0.35

INF = float("inf")


def cleaned(score: str, largest: float) -> Column:
    """NaN, null and -inf become 0, +inf the largest finite score."""
    value = quoted(score).cast("double")
    out = F.when(value.isNull() | F.isnan(value) | (value == F.lit(-INF)), F.lit(0.0))
    return out.when(value == F.lit(INF), F.lit(largest)).otherwise(value)


def normalization(df: DataFrame, scores: Sequence[str], rows: int | None = None) -> dict[str, dict]:
    """Per source the clip range and the finite maximum.

    One pass for all sources; only a source that holds +inf, whose place is taken by the
    largest finite score, needs a second one.
    """
    probs = [0.0, 0.01, 0.99, 1.0]
    extra = {}
    for i, s in enumerate(scores):
        plain = ~F.isnan(quoted(s)) & (F.abs(quoted(s)) != F.lit(INF))
        extra[f"m{i}"] = F.max(F.when(plain, quoted(s)))
        extra[f"i{i}"] = F.count_if(quoted(s) == F.lit(INF))
    q, seen = quantiles_with(df, {s: F.when(cleaned(s, INF) != F.lit(INF), cleaned(s, INF)) for s in scores}, probs, extra, rows=rows)
    largest = {s: seen[f"m{i}"] if seen[f"m{i}"] is not None else 0.0 for i, s in enumerate(scores)}
    infinite = [s for i, s in enumerate(scores) if seen[f"i{i}"]]
    if infinite:
        q |= quantiles(df, {s: cleaned(s, largest[s]) for s in infinite}, probs, rows=rows)
    out = {}
    for s in scores:
        low, p1, p99, high = q[s] if q[s][0] is not None else (0.0, 0.0, 0.0, 0.0)
        if p99 > p1:
            low, high = p1, p99
        out[s] = {"largest": largest[s], "low": low, "high": high}
    return out


def normalized(score: str, fit: Mapping[str, float]) -> Column:
    """Score clipped to its 1%-99% range and scaled to 0..1; a flat score gives 0."""
    span = fit["high"] - fit["low"]
    if span < 1e-8:
        return F.lit(0.0)
    value = F.least(F.greatest(cleaned(score, fit["largest"]), F.lit(fit["low"])), F.lit(fit["high"]))
    return (value - F.lit(fit["low"])) / F.lit(span)


def normalize(df: DataFrame, scores: Sequence[str], suffix: str = "__norm") -> DataFrame:
    fits = normalization(df, scores)
    return df.withColumns({f"{s}{suffix}": normalized(s, fits[s]) for s in scores})


def variances(df: DataFrame, columns: Mapping[str, Column]) -> dict[str, float]:
    names = list(columns)
    row = df.agg(*[F.var_pop(columns[n]).alias(f"v{i}") for i, n in enumerate(names)]).first()
    return {n: row[f"v{i}"] or 0.0 for i, n in enumerate(names)}


def ensemble_weights(
    variance: Mapping[str, float], *, named: bool = True, calibrated: Mapping[str, float] | None = None
) -> dict[str, float]:
    """Prior weight times variance (at least 0.05), damped next to flatline, summing to 1."""
    if named:
        base = {**BASE_WEIGHTS, **(calibrated or {})}
        raw = {n: base.get(n, OTHER_WEIGHT) * max(MIN_VARIANCE, v) for n, v in variance.items()}
        if "flatline" in raw:
            raw = {n: w if n == "flatline" else w * FLATLINE_DAMPING for n, w in raw.items()}
    else:
        raw = dict(variance)
    total = sum(raw.values())
    return {n: (w / total if total > 0 else 1.0 / len(raw)) for n, w in raw.items()}


def combine(
    df: DataFrame, scores: Sequence[str], *, calibrated: Mapping[str, float] | None = None, name: str = "ensemble",
    fits: Mapping[str, dict] | None = None,
) -> tuple[DataFrame, dict[str, float]]:
    """Add the weighted sum of the normalised scores; return it with the weights."""
    fits = fits or normalization(df, scores)
    columns = {s: normalized(s, fits[s]) for s in scores}
    weights = ensemble_weights(variances(df, columns), calibrated=calibrated)
    total = sum((columns[s] * F.lit(weights[s]) for s in scores), F.lit(0.0))
    return df.withColumn(name, total), weights


def open_gates(df: DataFrame, rows: int) -> list[str]:
    """Domain scores that join the ensemble.

    The second-highest flatline score reaches the gate exactly when two rows do.
    """
    out = []
    high = df.agg(F.count_if(F.col("flatline") >= FLATLINE_GATE).alias("n")).first()["n"]
    if rows and high >= min(2, rows):
        out.append("flatline")
    if rows >= TEMPORAL_MIN_ROWS:
        out.append("temporal_change")
    p95 = quantiles(df, ["freeze"], [0.95], rows=rows)["freeze"][0]
    if p95 is not None and p95 >= FREEZE_GATE:
        out.append("freeze")
    return out
