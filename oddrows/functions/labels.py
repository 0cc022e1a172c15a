"""Finding, normalising and deriving 0/1 labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddrows.functions.schema import find_by_name, norm, numeric_columns, quoted

# Column names and label words.
BINARY_LABEL_NAMES = ("label", "target", "ground_truth", "y_true", "is_anomaly", "anomaly")
DATA_LABEL_NAMES = ("ground_truth", "label", "target", "y_true", "is_anomaly", "anomaly")
CLASS_NAMES = ("class", "category", "type", "target", "digit", "glass_type")
PREPARE_CLASS_NAMES = ("label", "target", "class", "category", "type", "digit", "glass_type")
POSITIVE_WORDS = ("1", "true", "yes", "anomaly", "abnormal")
NEGATIVE_WORDS = ("0", "false", "no", "normal")
EXTRA_POSITIVE_WORDS = ("attack",)
EXTRA_NEGATIVE_WORDS = ("benign",)
FINDER_WORDS = ("0", "1", "true", "false", "normal", "anomaly")
MAX_CLASSES = 50


def binary_label(c: Column, extended: bool = False) -> Column:
    """0/1 from words, else from the number's sign, else 0."""
    text = F.lower(F.trim(c.cast("string")))
    positive = POSITIVE_WORDS + (EXTRA_POSITIVE_WORDS if extended else ())
    negative = NEGATIVE_WORDS + (EXTRA_NEGATIVE_WORDS if extended else ())
    value = c.cast("string").try_cast("double")
    by_number = F.coalesce((F.nanvl(value, F.lit(0.0)) > 0).cast("int"), F.lit(0))
    return F.when(text.isin(*positive), 1).when(text.isin(*negative), 0).otherwise(by_number)


def find_binary_label(df: DataFrame) -> str | None:
    """First column of the fixed name list whose values are numbers or known words."""
    by_name = {norm(c): c for c in df.columns}
    candidates = [by_name[n] for n in BINARY_LABEL_NAMES if n in by_name]
    if not candidates:
        return None
    aggs = []
    for i, name in enumerate(candidates):
        text = quoted(name).cast("string")
        value = text.try_cast("double")
        known = F.lower(F.trim(text)).isin(*FINDER_WORDS)
        aggs += [
            F.count(text).alias(f"n{i}"),
            F.count_if(text.isNotNull() & (value.isNull() | F.isnan(value))).alias(f"text{i}"),
            F.count_if(text.isNotNull() & ~known).alias(f"odd{i}"),
        ]
    row = df.agg(*aggs).first()
    for i, name in enumerate(candidates):
        if row[f"n{i}"] and (row[f"text{i}"] == 0 or row[f"odd{i}"] == 0):
            return name
    return None


def rare_values(counts: dict) -> list:
    """Classes at or below the 25th percentile of class sizes; the rarest when that takes none or all."""
    if len(counts) < 2:
        raise ValueError("the label column must hold at least two classes")
    sizes = sorted(counts.values())
    position = 0.25 * (len(sizes) - 1)
    low = int(position)
    cutoff = sizes[low] + (sizes[min(low + 1, len(sizes) - 1)] - sizes[low]) * (position - low)
    rare = [c for c, m in counts.items() if m <= cutoff]
    if not rare or len(rare) == len(counts):
        rare = [rarest(counts)]
    return rare


def rarest(counts: dict) -> object:
    return min(counts, key=lambda c: (counts[c], c))


def count_classes(df: DataFrame, column: str, limit: int = MAX_CLASSES) -> dict | None:
    """Class sizes without nulls, or None when there are more than ``limit`` classes."""
    rows = df.filter(quoted(column).isNotNull()).groupBy(quoted(column).alias("c")).count().limit(limit + 1).collect()
    return None if len(rows) > limit else {r["c"]: r["count"] for r in rows}


def rare_class_label(df: DataFrame, column: str, name: str = "ground_truth") -> DataFrame | None:
    """Flag the rare classes of a class-like column; None when the column is unsuitable."""
    counts = count_classes(df, column)
    if counts is None or not 2 <= len(counts) <= min(MAX_CLASSES, max(2, sum(counts.values()) // 2)):
        return None
    rare = rare_values(counts)
    flagged = sum(counts[c] for c in rare)
    if flagged == 0 or flagged == sum(counts.values()):
        return None
    return df.withColumn(name, F.coalesce(quoted(column).isin(rare), F.lit(False)).cast("int"))


def find_class_label(df: DataFrame, name: str = "ground_truth") -> tuple[str, DataFrame] | None:
    """First class-like column from which a rare-class label can be derived."""
    by_name = {norm(c): c for c in df.columns}
    for candidate in CLASS_NAMES:
        if candidate in by_name:
            labelled = rare_class_label(df, by_name[candidate], name)
            if labelled is not None:
                return by_name[candidate], labelled
    return None


def label_from_values(df: DataFrame, column: str, values: list, name: str = "ground_truth") -> DataFrame:
    """1 where the column holds one of the values; text values take the column's type."""
    dtype = df.schema[column].dataType
    typed = [F.lit(v).cast(dtype) if isinstance(dtype, T.NumericType) else F.lit(str(v)) for v in values]
    out = df.withColumn(name, F.coalesce(quoted(column).isin(*typed), F.lit(False)).cast("int"))
    row = out.agg(F.sum(name).alias("p"), F.count(F.lit(1)).alias("n")).first()
    if not row["p"] or row["p"] == row["n"]:
        raise ValueError("all rows would get the same label")
    return out


def rarest_class_label(df: DataFrame, column: str, drop: tuple[str, ...] = (), name: str = "ground_truth") -> DataFrame:
    """1 for the single rarest class; the class and id columns are dropped."""
    best = (
        df.filter(quoted(column).isNotNull()).groupBy(quoted(column).alias("c")).count()
        .agg(F.min_by("c", F.struct("count", "c")).alias("c")).first()["c"]
    )
    out = df.withColumn(name, F.coalesce(quoted(column) == F.lit(best), F.lit(False)).cast("int"))
    return out.drop(column, *drop)


def one_against_rest(df: DataFrame, column: str, value, drop: tuple[str, ...] = (), name: str = "ground_truth") -> DataFrame:
    """1 where the column equals the value, in any letter case for text."""
    if isinstance(df.schema[column].dataType, T.StringType):
        hit = F.upper(quoted(column)) == F.upper(F.lit(str(value)))
    else:
        hit = quoted(column) == F.lit(value)
    return df.withColumn(name, F.coalesce(hit, F.lit(False)).cast("int")).drop(column, *drop)


def spike_column(df: DataFrame) -> str | None:
    """Column that gets the stand-in spikes: latency first, then error or cpu, else the first."""
    cols = numeric_columns(df)
    by_latency = next((c for c in cols if "latency" in c.lower()), None)
    by_load = next((c for c in cols if "error" in c.lower() or "cpu" in c.lower()), None)
    return by_latency or by_load or (cols[0] if cols else None)


def synthetic_labels(df: DataFrame, key: list[str], seed: int = 42, name: str = "synthetic_ground_truth") -> DataFrame | None:
    """Spike one column to have something to measure when the table has no labels."""
    from oddrows.operators.inject import inject

    column = spike_column(df)
    if column is None:
        return None
    share = 0.15 if df.count() < 50 else 0.1
    params = {"column": column, "contamination": share, "magnitude_in_std": 5.0}
    return inject(df, "spike_single", key=key, seed=seed, params=params, label=name)


def label_column(df: DataFrame, explicit: str | None = None) -> str | None:
    """Label column of a prepared data set by name."""
    return find_by_name(df, DATA_LABEL_NAMES, explicit)
