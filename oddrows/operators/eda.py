"""Exploratory report of a table as a set of small DataFrames."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddrows.functions.schema import categorical_columns, number, numeric_columns, quoted
from oddrows.operators.joins import HOT_SHARE
from oddrows.operators.ordered import average_ranks, bucketize
from oddrows.operators.profile import sample_kurtosis, sample_skewness
from oddrows.operators.ranks import quantiles
from oddrows.operators.sampling import seeded_pick
from oddrows.session import keep, materialize

ROW = "__row"
SCATTER_POINTS = 2800
HISTOGRAM_BINS = 22
CATEGORICAL_TOP = 10
TOP_PAIRS = 10
DATETIME_SHARE = 0.8
RARE_SHARE = 0.01
SKEW_WARNING = 2.0
MISSING_WARNING = 0.4
# Date and time layouts tried on text columns.
DATETIME_FORMATS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy/MM/dd", "yyyy/MM/dd HH:mm:ss",
    "MM/dd/yyyy", "MM/dd/yyyy HH:mm:ss", "dd-MM-yyyy",
)


def column_metadata(df: DataFrame, approximate: bool = False) -> DataFrame:
    """(position, column, dtype, is_numeric, missing_count, missing_pct, nunique).

    Distinct values are counted as (column, value) pairs, summed in each task first: one pass, no copy of a row per column.
    """
    numbers = set(numeric_columns(df))
    values = [number(c) + F.lit(0.0) if c in numbers else quoted(c) for c in df.columns]
    named = df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString(), isinstance(f.dataType, (T.NumericType, T.BooleanType))) for i, f in enumerate(df.schema.fields)],
        "position int, column string, dtype string, is_numeric boolean")
    if approximate:
        cells = [F.struct(F.lit(i).alias("position"), F.count(v).alias("present"), F.approx_count_distinct(v).alias("nunique")) for i, v in enumerate(values)]
        found = df.agg(F.count(F.lit(1)).alias("rows"), F.array(*cells).alias("cells")).select("rows", F.inline("cells"))
    else:
        cells = F.array(*[F.struct(F.lit(i).alias("position"), v.cast("string").alias("v")) for i, v in enumerate(values)])
        pairs = df.select(F.explode(cells).alias("x")).select("x.*").groupBy("position", "v").count()
        found = pairs.groupBy("position").agg(
            F.sum("count").alias("rows"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("count"))), F.lit(0)).alias("present"), F.count("v").alias("nunique"))
    gone = F.coalesce(F.col("rows") - F.col("present"), F.lit(0))
    return named.join(found, "position", "left").select(
        "position", "column", "dtype", "is_numeric", gone.alias("missing_count"), F.round(F.coalesce(gone / F.col("rows"), F.lit(0.0)) * 100, 3).alias("missing_pct"),
        F.coalesce("nunique", F.lit(0)).alias("nunique"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each identical group, and their share in percent."""
    groups = df.groupBy(*[quoted(c) for c in df.columns]).count()
    return groups.agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_row_count"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("rows"),
    ).select(
        "duplicate_row_count",
        F.when(F.col("rows") > 0, F.round(F.col("duplicate_row_count") / F.col("rows") * 100, 3))
        .otherwise(F.lit(0.0)).alias("duplicate_row_pct"),
    )


def numeric_summary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row per numeric column, with Tukey and z outlier counts.

    One aggregate for moments, one for exact quartiles, one for the outlier counts against
    the fences; nothing is unpivoted or shuffled.
    """
    cols = cols or numeric_columns(df)
    spark = df.sparkSession
    aggs = []
    for i, c in enumerate(cols):
        x = number(c)
        aggs += [
            F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}"),
            F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}"),
            sample_skewness(x).alias(f"k{i}"), sample_kurtosis(x).alias(f"u{i}"),
        ]
    moments = df.agg(F.count(F.lit(1)).alias("rows"), *aggs).first()
    q = quantiles(df, {c: number(c) for c in cols}, [0.25, 0.5, 0.75], rows=moments["rows"])
    counts = []
    for i, c in enumerate(cols):
        x, n = number(c), moments[f"n{i}"]
        q1, _, q3 = q[c]
        if n >= 4 and q3 > q1:
            low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
            counts.append(F.count_if((x < F.lit(low)) | (x > F.lit(high))).alias(f"t{i}"))
        else:
            counts.append(F.lit(0).cast("long").alias(f"t{i}"))
        if n and moments[f"s{i}"] > 0:
            z = (x - F.lit(moments[f"m{i}"])) / F.lit(moments[f"s{i}"])
            counts.append(F.count_if(F.abs(z) > 3.0).alias(f"z{i}"))
        else:
            counts.append(F.lit(0).cast("long").alias(f"z{i}"))
    o = df.agg(F.count(F.lit(1)).alias("rows"), *counts).first()
    rows = [
        (
            c, moments[f"n{i}"], moments[f"m{i}"], moments[f"s{i}"], moments[f"a{i}"], q[c][0], q[c][1], q[c][2],
            moments[f"b{i}"], moments[f"k{i}"], moments[f"u{i}"], o[f"t{i}"], o[f"z{i}"],
        )
        for i, c in enumerate(cols)
    ]
    schema = (
        "column string, count long, mean double, std double, min double, p25 double, median double, p75 double, "
        "max double, skew double, kurtosis double, tukey_outlier_count long, z_outlier_count long"
    )
    return spark.createDataFrame(rows, schema)


def categorical_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, value, count) of the text-like columns, nulls left out."""
    cols = cols or categorical_columns(df)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in cols])
    long = df.select(F.explode(cells).alias("x")).select("x.*").filter(F.col("value").isNotNull())
    return long.groupBy("column", "value").count()


def categorical_summary(df: DataFrame, cols: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """(column, nunique, rare_count): rare values hold below 1% of all rows."""
    rows = df.count() if rows is None else rows
    rare = F.count_if(F.col("count") / F.lit(max(1, rows)) < RARE_SHARE)
    return categorical_counts(df, cols).groupBy("column").agg(F.count(F.lit(1)).alias("nunique"), rare.alias("rare_count"))


def categorical_top(df: DataFrame, cols: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """Ten most frequent values per column; the rank filter is pushed below the shuffle."""
    rows = df.count() if rows is None else rows
    w = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    return (
        categorical_counts(df, cols)
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= CATEGORICAL_TOP)
        .withColumn("pct", F.round(F.col("count") / F.lit(max(1, rows)) * 100, 3))
    )


def datetime_columns(df: DataFrame, formats: tuple[str, ...] = DATETIME_FORMATS) -> DataFrame:
    """Columns that are, or parse as, points in time: share parsed, min, max, range in days."""
    parts = []
    for f in df.schema.fields:
        value = quoted(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            parsed = value.cast("timestamp")
        elif isinstance(f.dataType, T.StringType):
            parsed = F.coalesce(F.try_to_timestamp(value), *[F.try_to_timestamp(value, F.lit(p)) for p in formats])
        else:
            continue
        parts.append((f.name, value, parsed))
    schema = "column string, parsed_pct double, min timestamp, max timestamp, range_days double"
    if not parts:
        return df.sparkSession.createDataFrame([], schema)
    aggs = []
    for i, (_, value, parsed) in enumerate(parts):
        aggs += [
            (F.count(parsed) / F.count(value)).alias(f"r{i}"), F.min(parsed).alias(f"a{i}"), F.max(parsed).alias(f"b{i}"),
        ]
    cells = F.array(*[
        F.struct(
            F.lit(name).alias("column"), F.round(F.col(f"r{i}") * 100, 2).alias("parsed_pct"), F.col(f"r{i}").alias("share"),
            F.col(f"a{i}").alias("min"), F.col(f"b{i}").alias("max"),
            ((F.unix_micros(f"b{i}") - F.unix_micros(f"a{i}")) / F.lit(86_400e6)).alias("range_days"),
        )
        for i, (name, _, _) in enumerate(parts)
    ])
    return df.agg(*aggs).select(F.inline(cells)).filter(F.col("share") >= DATETIME_SHARE).drop("share")


def top_variance_columns(df: DataFrame, limit: int | None = None, cols: list[str] | None = None) -> list[str]:
    """Numeric columns by falling variance, ties in column order."""
    cols = cols or numeric_columns(df)
    row = df.agg(*[F.coalesce(F.var_pop(number(c)), F.lit(0.0)).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    order = sorted(range(len(cols)), key=lambda i: (-row[f"v{i}"], i))
    return [cols[i] for i in order[:limit]]


def complete_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[number(c).alias(c) for c in cols]).dropna(subset=cols)


def pearson_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(a, b, pearson) for all ordered pairs over rows complete in every chosen column."""
    cols = cols or top_variance_columns(df)
    return _matrix(complete_rows(df, cols), cols, cols, "pearson")


def _matrix(df: DataFrame, sources: list[str], names: list[str], label: str) -> DataFrame:
    pairs = [(i, j) for i in range(len(names)) for j in range(len(names))]
    # (Not ``corr``: it divides by zero, which is an error in ANSI mode, where a column is constant.)
    spread = [F.stddev_pop(quoted(c)) for c in sources]
    aggs = [(F.covar_pop(quoted(sources[i]), quoted(sources[j])) / F.nullif(spread[i] * spread[j], F.lit(0.0))).alias(f"r{i}_{j}") for i, j in pairs if i < j]
    aggs += [F.max(quoted(c)).alias(f"x{i}") for i, c in enumerate(sources)]
    aggs += [F.min(quoted(c)).alias(f"n{i}") for i, c in enumerate(sources)]

    def cell(i: int, j: int):
        if i == j:
            return F.when(F.col(f"x{i}") > F.col(f"n{i}"), F.lit(1.0)).otherwise(F.lit(0.0))
        r = F.col(f"r{min(i, j)}_{max(i, j)}")
        return F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0))

    cells = F.array(*[
        F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), cell(i, j).alias(label)) for i, j in pairs
    ])
    return df.agg(*aggs).select(F.inline(cells))


def spearman_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(a, b, spearman): Pearson on average ranks.

    Ranks are computed per distinct value. Frequent values find theirs map-side, in a broadcast dictionary a column. The rest
    of all columns become (row, column, value) cells: one shuffle brings them to their ranks and one back to their rows.
    """
    cols = cols or top_variance_columns(df)
    work = materialize(complete_rows(df, cols).select(F.monotonically_increasing_id().alias(ROW), *[(quoted(c) + F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(cols)]))
    numbered = list(range(len(cols)))
    ranks = keep(average_ranks(work, {str(i): F.col(f"x{i}") for i in numbered}).select(F.col("column").cast("int").alias("place"), "value", "n", "avg_rank"))
    cut = max(1.0, work.count() * HOT_SHARE)
    rare = {r["place"] for r in ranks.where(F.col("n") < cut).select("place").distinct().collect()}
    names, out = [f"r{i}" for i in numbered], work
    for i in numbered:  # at most 1 / HOT_SHARE values a column are frequent
        frequent = ranks.where((F.col("place") == i) & (F.col("n") >= cut)).select(F.col("value").alias(f"x{i}"), F.col("avg_rank").alias(f"r{i}"))
        out = out.join(F.broadcast(frequent), f"x{i}", "left")
    if rare:
        cells = F.filter(F.array(*[F.struct(F.lit(i).alias("place"), F.when(F.col(f"r{i}").isNull(), F.col(f"x{i}")).alias("value")) for i in sorted(rare)]), lambda c: c["value"].isNotNull())
        found = out.select(ROW, F.inline(cells)).join(ranks.where(F.col("n") < cut).select("place", "value", "avg_rank"), ["place", "value"])
        back = found.groupBy(ROW).agg(*[F.max(F.when(F.col("place") == i, F.col("avg_rank"))).alias(f"b{i}") for i in sorted(rare)])
        out = out.join(back, ROW, "left").withColumns({f"r{i}": F.coalesce(f"r{i}", f"b{i}") for i in sorted(rare)})
    return _matrix(out, names, cols, "spearman")


def top_correlations(
    df: DataFrame, cols: list[str] | None = None, limit: int = TOP_PAIRS, *, pearson: DataFrame | None = None, spearman: DataFrame | None = None
) -> DataFrame:
    """Strongest pairs by absolute Pearson, with Spearman beside it; matrices already made may be given."""
    cols = cols or top_variance_columns(df)
    order = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    both = (pearson_matrix(df, cols) if pearson is None else pearson).join(spearman_matrix(df, cols) if spearman is None else spearman, ["a", "b"])
    upper = both.filter(order[F.col("a")] < order[F.col("b")])
    return (
        upper.withColumn("abs_pearson", F.abs("pearson"))
        .orderBy(F.desc("abs_pearson"), "a", "b").limit(limit)
    )


def scatter_sample(df: DataFrame, key: list[str], x: str, y: str, points: int = SCATTER_POINTS, seed: int = 0) -> DataFrame:
    """Complete rows of one pair, at most ``points`` of them, chosen by hash."""
    rows = df.select(*[quoted(k) for k in key], number(x).alias("x"), number(y).alias("y")).dropna(subset=["x", "y"])
    return seeded_pick(rows, key, points, seed)


def boxplots(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Five-number summaries with whiskers clipped to the data range."""
    cols = cols or top_variance_columns(df)
    ends = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[f(number(c)).alias(f"{n}{i}") for i, c in enumerate(cols) for f, n in ((F.count, "n"), (F.min, "a"), (F.max, "b"))],
    ).first()
    q = quantiles(df, {c: number(c) for c in cols}, [0.25, 0.5, 0.75], rows=ends["rows"])
    rows = []
    for i, c in enumerate(cols):
        if ends[f"n{i}"] < 4:
            continue
        q1, med, q3 = q[c]
        spread = (q3 - q1) or 1e-12
        low, high = ends[f"a{i}"], ends[f"b{i}"]
        rows.append((c, low, high, max(low, q1 - 1.5 * spread), q1, med, q3, min(high, q3 + 1.5 * spread)))
    schema = (
        "column string, min double, max double, whisker_low double, q1 double, median double, q3 double, whisker_high double"
    )
    return df.sparkSession.createDataFrame(rows, schema)


def histograms(df: DataFrame, cols: list[str] | None = None, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(column, bin, left, right, count), left-closed bins, the last one closed."""
    spark = df.sparkSession
    cols = cols or top_variance_columns(df)
    ends = df.agg(*[f(number(c)).alias(f"{n}{i}") for i, c in enumerate(cols) for f, n in ((F.min, "a"), (F.max, "b"))]).first()
    edges = {}
    for i, c in enumerate(cols):
        low, high = ends[f"a{i}"], ends[f"b{i}"]
        if low is None:
            continue
        if low == high:
            low, high = low - 0.5, high + 0.5
        edges[c] = [float(e) for e in np.linspace(low, high, bins + 1)]
    kept = list(edges)
    work = df.select(*[number(c).alias(f"v{i}") for i, c in enumerate(kept)])
    # Interior edges only: below the first is bin 0, from the last one on is the last bin.
    work = bucketize(work, [f"v{i}" for i in range(len(kept))], [f"b{i}" for i in range(len(kept))], [edges[c][1:-1] for c in kept])
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.when(F.col(f"v{i}").isNotNull(), F.col(f"b{i}").cast("int")).alias("bin"))
        for i, c in enumerate(kept)
    ])
    counted = (
        work.select(F.explode(cells).alias("x")).select("x.*").filter(F.col("bin").isNotNull())
        .groupBy("column", "bin").count()
    )
    frame = spark.createDataFrame(
        [(c, b, edges[c][b], edges[c][b + 1]) for c in kept for b in range(bins)],
        "column string, bin int, left double, right double",
    )
    return frame.join(counted, ["column", "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)))


def quality_warnings(
    df: DataFrame, meta: DataFrame | None = None, num: DataFrame | None = None, categories: DataFrame | None = None, duplicates: DataFrame | None = None
) -> DataFrame:
    """(kind, column, value) rows for missing, constant, skewed, rare and duplicate findings; parts already made may be given."""
    empty: list[DataFrame] = []
    meta = column_metadata(df) if meta is None else meta
    empty.append(
        meta.filter(F.col("missing_pct") > MISSING_WARNING * 100)
        .select(F.lit("missing").alias("kind"), "column", F.col("missing_pct").alias("value"))
    )
    if numeric_columns(df):
        num = numeric_summary(df) if num is None else num
        empty.append(num.filter(F.col("std") < 1e-12).select(F.lit("constant").alias("kind"), "column", F.col("std").alias("value")))
        empty.append(
            num.filter(F.abs("skew") > SKEW_WARNING).select(F.lit("skew").alias("kind"), "column", F.col("skew").alias("value"))
        )
    else:
        empty.append(df.sparkSession.createDataFrame([("no_numeric", None, None)], "kind string, column string, value double"))
    if categorical_columns(df):
        rare = (categorical_summary(df) if categories is None else categories).filter((F.col("rare_count") > 0) & (F.col("nunique") > CATEGORICAL_TOP))
        empty.append(rare.select(F.lit("rare").alias("kind"), "column", F.col("rare_count").cast("double").alias("value")))
    dup = (duplicate_rows(df) if duplicates is None else duplicates).filter(F.col("duplicate_row_count") > 0)
    empty.append(
        dup.select(F.lit("duplicates").alias("kind"), F.lit(None).cast("string").alias("column"),
                   F.col("duplicate_row_count").cast("double").alias("value"))
    )
    return reduce(DataFrame.unionByName, empty)


def eda_report(df: DataFrame, key: list[str], *, max_rows: int | None = None) -> dict[str, DataFrame]:
    """Every part of the report by name; ``max_rows`` keeps the first rows by key instead of all."""
    if max_rows is not None:
        df = df.orderBy(*[quoted(k) for k in key]).limit(max_rows)
    report = {
        "overview": df.agg(F.count(F.lit(1)).alias("row_count"), F.lit(len(df.columns)).alias("column_count")),
        "duplicates": keep(duplicate_rows(df)),
        "columns": keep(column_metadata(df)),
        "datetime_columns": datetime_columns(df),
    }
    if categorical_columns(df):
        report["categorical_summary"] = keep(categorical_summary(df))
        report["categorical_top"] = categorical_top(df)
    if numeric_columns(df):
        report["numeric_summary"] = numeric_summary(df)
        report["boxplots"] = boxplots(df)
        report["histograms"] = histograms(df)
    report["warnings"] = quality_warnings(df, report["columns"], report.get("numeric_summary"), report.get("categorical_summary"), report["duplicates"])
    if len(numeric_columns(df)) >= 2:
        cols = top_variance_columns(df)
        report["pearson"] = keep(pearson_matrix(df, cols))
        report["spearman"] = keep(spearman_matrix(df, cols))
        report["top_correlations"] = top_correlations(df, cols, pearson=report["pearson"], spearman=report["spearman"])
        best = report["top_correlations"].first()
        if best is not None:
            report["scatter"] = scatter_sample(df, key, best["a"], best["b"])
    return report
