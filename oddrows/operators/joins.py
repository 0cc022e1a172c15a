"""Joins of the score and study tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddrows.functions.schema import quoted
from oddrows.operators.metrics import percentile_counts
from oddrows.session import keep

MAX_PROFILES = 10_000
HOT_SHARE = 1e-3
SALTS = 4096


def value_lookup(rows: DataFrame, values: DataFrame, keys: Sequence[str], weight: str, total: int) -> DataFrame:
    """``rows`` with the other columns of ``values`` (one row a key; ``weight``: how many rows have the key), whatever the skew.

    Keys that hold at least HOT_SHARE of the ``total`` rows are at most 1 / HOT_SHARE, so they are looked up map-side in a
    broadcast dictionary. Rows met there carry a salt instead of the key and are dealt evenly; the others are shuffled by key.
    """
    names = [c for c in values.columns if c not in keys]
    cut = max(1.0, total * HOT_SHARE)
    hot = values.where(F.col(weight) >= cut).select(*keys, F.struct(*names).alias("__hot"))
    # (The right side's salt is always 0 but no constant, else it would be dropped from the join's keys.)
    cold = values.where(F.col(weight) < cut).select(
        *[F.col(k).alias(f"__r{i}") for i, k in enumerate(keys)], F.pmod(F.xxhash64(*keys), F.lit(1)).cast("int").alias("__rs"), F.struct(*names).alias("__cold"))
    met = rows.join(F.broadcast(hot), list(keys), "left")
    free = F.col("__hot").isNull()
    salt = F.when(free, F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(*[quoted(c) for c in rows.columns]), F.lit(SALTS))).cast("int")
    met = met.withColumns({**{f"__l{i}": F.when(free, F.col(k)) for i, k in enumerate(keys)}, "__ls": salt})
    same = [F.col(f"__l{i}") == F.col(f"__r{i}") for i in range(len(keys))]
    found = met.join(cold, [*same, F.col("__ls") == F.col("__rs")], "left").withColumn("__found", F.coalesce("__hot", "__cold"))
    return found.select(*[quoted(c) for c in rows.columns], *[F.col("__found").getField(n).alias(n) for n in names])


def value_counts_joined(df: DataFrame, value: Column, name: str = "value_count") -> DataFrame:
    """Each row beside the number of rows that share its value; rows without a value are left out."""
    valued = df.withColumn("__v", value).where(F.col("__v").isNotNull())
    counts = keep(valued.groupBy("__v").agg(F.count(F.lit(1)).alias(name)))
    total = counts.agg(F.coalesce(F.sum(name), F.lit(0))).first()[0]
    return value_lookup(valued, counts, ["__v"], name, total).drop("__v")


def rows_in_classes(df: DataFrame, column: str, classes: DataFrame) -> DataFrame:
    """Rows whose class occurs in the class list."""
    return df.join(classes, column, "left_semi")


def consistency(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Metrics of two runs side by side with their differences."""
    a = real.select("dataset", "score_source", F.col("roc_auc").alias("real_roc_auc"), F.col("pr_auc").alias("real_pr_auc"))
    b = synthetic.select("dataset", "score_source", F.col("roc_auc").alias("synthetic_roc_auc"), F.col("pr_auc").alias("synthetic_pr_auc"))
    return a.join(b, ["dataset", "score_source"]).withColumns({
        "delta_roc_auc": F.round(F.col("synthetic_roc_auc") - F.col("real_roc_auc"), 6),
        "delta_pr_auc": F.round(F.col("synthetic_pr_auc") - F.col("real_pr_auc"), 6),
    })


def parameter_grid(spark, grid: Mapping[str, Sequence]) -> DataFrame:
    """Every combination of the listed values, one row each; an empty grid is one empty row.

    The lists are exploded one after the other, so no join is planned.
    """
    out = spark.range(1)
    for name, values in grid.items():
        values = list(values) if isinstance(values, (list, tuple)) else [values]
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out.drop("id") if grid else out.select(F.lit(0).alias("combo"))


def rows_above_percentiles(df: DataFrame, score: str, percentiles: Sequence[float]) -> DataFrame:
    """(percentile, threshold, rows_above): all cuts against all scores without multiplying rows."""
    flagged = df.select(quoted(score), F.lit(1).alias("__y"))
    found = percentile_counts(flagged, "__y", [score], percentiles)[score]
    rows = [(e["percentile"], e["threshold"], e["tp"]) for e in found]
    return df.sparkSession.createDataFrame(rows, "percentile double, threshold double, rows_above long")


def nearest_profile(df: DataFrame, features: Sequence[str], profiles: DataFrame, name: str) -> DataFrame:
    """Add the nearest profile's name and Euclidean distance (ties by name).

    Profiles hold one row per studied data set. Their number is checked; they enter the plan
    as a literal array, so rows are neither joined nor shuffled.
    """
    listed = profiles.select(name, *[quoted(f).cast("double") for f in features]).limit(MAX_PROFILES + 1).collect()
    if len(listed) > MAX_PROFILES:
        raise ValueError(f"more than {MAX_PROFILES} profiles")
    if not listed:
        return df.withColumns({"matched": F.lit(None).cast("string"), "distance": F.lit(None).cast("double")})
    entries = F.array(*[
        F.struct(F.lit(r[0]).alias("matched"), F.array(*[F.lit(v) for v in r[1:]]).alias("v")) for r in listed
    ])
    own = F.array(*[quoted(f).cast("double") for f in features])

    def measured(e: Column) -> Column:
        gaps = F.zip_with(own, e["v"], lambda a, b: (a - b) * (a - b))
        return F.struct(F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g)).alias("distance"), e["matched"].alias("matched"))

    best = F.array_min(F.transform(entries, measured))
    return df.withColumn("__best", best).withColumns({
        "matched": F.col("__best")["matched"], "distance": F.col("__best")["distance"],
    }).drop("__best")


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def common_datasets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Names on both sides. Each side's are made distinct map-side, so no task meets the rows of a frequent name."""
    return a.select("dataset").distinct().intersect(b.select("dataset").distinct())


def either_label(df: DataFrame, a: str, b: str, name: str = "y_combined") -> DataFrame:
    return df.withColumn(name, F.greatest(quoted(a), quoted(b)))


def pick_source(df: DataFrame, source: str, *, fallback: str = "ensemble") -> DataFrame:
    """(key.., score) of one source from the wide score table, else of the ensemble."""
    column = source if source in df.columns else fallback
    return df.withColumn("score", quoted(column))
