"""Ordered work over a whole table without a single-partition window.

The table is cut into buckets at whole sort tuples (order columns, then key) of the
columns' own types, taken from a hash sample of bounded size. Rows are compared with the
cuts as tuples, by the same rules as the sort itself, so strings with a common prefix,
tied values, nulls and NaN fall where the sort puts them, and an order value held by many
rows is cut at its keys. A row's bucket depends on the row alone: nothing changes when a
task is recomputed, and no lineage has to be cut. A window then runs per bucket (one
shuffle), and what must cross a bucket edge (a few edge rows, or running totals) is a
summary with one entry per bucket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddrows.functions.schema import quoted
from oddrows.operators.ranks import prob_array

BUCKET = "__bucket"
HALO = "__halo"
MAX_BUCKETS = 1024
ROWS_PER_BUCKET = 250_000
MIN_ROWS_PER_BUCKET = 5_000
SAMPLE_PER_BUCKET = 64


def bucket_count(rows: int, parallelism: int) -> int:
    """Buckets for ``rows``: enough to use the cluster, never tiny, never unbounded."""
    wanted = max(math.ceil(rows / ROWS_PER_BUCKET), min(parallelism, math.ceil(rows / MIN_ROWS_PER_BUCKET)))
    return max(1, min(MAX_BUCKETS, wanted))


def bucketize(df: DataFrame, inputs: list[str], outputs: list[str], cuts: list[list[float]]) -> DataFrame:
    """Index of each value among its sorted cuts (binary search in the JVM); NaN goes last."""
    plain = [(i, o) for i, o, c in zip(inputs, outputs, cuts) if not c]
    cut = [(i, o, c) for i, o, c in zip(inputs, outputs, cuts) if c]
    df = df.withColumns({o: F.lit(0.0) for _, o in plain}) if plain else df
    if not cut:
        return df
    inf = float("inf")
    return Bucketizer(
        inputCols=[i for i, _, _ in cut],
        outputCols=[o for _, o, _ in cut],
        splitsArray=[[-inf, *c, inf] for _, _, c in cut],
        handleInvalid="keep",
    ).transform(df)


@dataclass
class Ordering:
    """A table cut into consecutive buckets along ``order_by`` then ``key``."""

    df: DataFrame
    sort: list[str]
    rows: int
    buckets: int
    window: object = field(init=False)

    def __post_init__(self) -> None:
        self.window = Window.partitionBy(BUCKET).orderBy(*[quoted(c) for c in self.sort])


def ordering(
    df: DataFrame, order_by: Sequence[str], key: Sequence[str], *, max_buckets: int = MAX_BUCKETS,
    buckets: int | None = None, rows: int | None = None,
) -> Ordering:
    """Add the bucket column for the total order (order_by, key).

    ``rows`` saves the counting pass when the table is known to fit one bucket.
    """
    sort = list(dict.fromkeys([*order_by, *key]))
    if rows is not None and (buckets or bucket_count(rows, df.sparkSession.sparkContext.defaultParallelism)) == 1:
        return Ordering(df.withColumn(BUCKET, F.lit(0).cast("long")), sort, rows, 1)
    parallelism = df.sparkSession.sparkContext.defaultParallelism
    if rows is None:
        rows = df.count()
    count = max(1, min(buckets or bucket_count(rows, parallelism), max_buckets))
    cuts = cut_tuples(df, sort, key, rows, count) if rows and count > 1 else []
    return Ordering(df.withColumn(BUCKET, bucket_of(df, sort, cuts)), sort, rows, len(cuts) + 1)


def cut_tuples(df: DataFrame, sort: Sequence[str], key: Sequence[str], rows: int, count: int) -> list[tuple]:
    """At most ``count - 1`` sort tuples (values as text) that cut the table into parts of about equal size.

    A hash of the key picks about ``SAMPLE_PER_BUCKET`` rows a bucket; Spark sorts them.
    """
    span = 1 << 40
    share = SAMPLE_PER_BUCKET * count / rows
    picked = df.select(*[quoted(c) for c in dict.fromkeys([*sort, *key])])
    if share < 1.0:
        hashed = F.xxhash64(F.lit("cuts"), *[quoted(c) for c in key])
        picked = picked.filter(F.pmod(hashed, F.lit(span)) < int(span * share))
    types = {f.name: f.dataType for f in df.schema.fields}
    ordered = picked.orderBy(*[quoted(c) for c in sort]).select(*[_as_text(c, types[c]) for c in sort]).collect()
    points = [tuple(ordered[round(i * len(ordered) / count)]) for i in range(1, count) if len(ordered) > 1]
    return list(dict.fromkeys(p for p in points if p != tuple(ordered[0])))


def _as_text(name: str, dtype: T.DataType) -> Column:
    """The value as text that ``_from_text`` reads back without loss."""
    value = quoted(name)
    if isinstance(dtype, T.TimestampType):
        value = F.unix_micros(value)
    elif isinstance(dtype, T.BinaryType):
        value = F.hex(value)
    elif not isinstance(dtype, T.AtomicType):
        raise ValueError(f"cannot order by column {name!r} of type {dtype.simpleString()}")
    return value.cast("string").alias(name)


def _from_text(text: str | None, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.TimestampType):
        return F.timestamp_micros(F.lit(text).cast("long"))
    if isinstance(dtype, T.BinaryType):
        return F.unhex(F.lit(text))
    return F.lit(text).cast(dtype)


def bucket_of(df: DataFrame, sort: Sequence[str], cuts: list[tuple]) -> Column:
    """How many cuts are at or below the row's sort tuple: first among every ``sqrt(n)``-th cut, then between two of them."""
    if not cuts:
        return F.lit(0).cast("long")
    types = {f.name: f.dataType for f in df.schema.fields}
    row = F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(sort)])
    made = [F.struct(*[_from_text(v, types[c]).alias(f"c{i}") for i, (c, v) in enumerate(zip(sort, cut))]) for cut in cuts]
    step = math.isqrt(len(made) - 1) + 1
    groups = [made[i : i + step] for i in range(0, len(made), step)]
    heads = F.array(*[g[0] for g in groups])
    passed = lambda held: F.size(F.filter(held, lambda c: c <= row))
    group = F.greatest(passed(heads) - 1, F.lit(0))
    inner = F.element_at(F.array(*[F.array(*g) for g in groups]), group + 1)
    return (group * F.lit(step) + passed(inner)).cast("long")


def with_halo(o: Ordering, before: int, after: int) -> Ordering:
    """Add to each bucket the ``before`` rows ahead of it and the ``after`` rows behind it.

    Added rows carry HALO = true. The edge rows are found with a pruned top-k window per
    bucket; at most (before + after) rows per bucket pass through the driver.
    """
    spark = o.df.sparkSession
    columns = [c for c in o.df.columns]
    if o.buckets == 1:
        return Ordering(o.df.withColumn(HALO, F.lit(False)), o.sort, o.rows, o.buckets)
    parts = []
    for size, descending, name in ((before, True, "tail"), (after, False, "head")):
        if size:
            by = [quoted(c).desc() if descending else quoted(c).asc() for c in o.sort]
            edge = Window.partitionBy(BUCKET).orderBy(*by)
            top = o.df.withColumn("__rn", F.row_number().over(edge)).filter(F.col("__rn") <= size)
            parts.append(top.withColumn("__side", F.lit(name)))
    union = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    edges: dict[str, dict[int, list]] = {"tail": {}, "head": {}}
    for r in union.collect():
        edges[r["__side"]].setdefault(r[BUCKET], []).append(r)
    ids = sorted(set(edges["tail"]) | set(edges["head"]))
    extra = []
    carry: list = []
    for b in ids:  # rows just ahead of bucket b, from as many earlier buckets as needed
        extra += [tuple(r[c] if c != BUCKET else b for c in columns) for r in carry]
        own = sorted(edges["tail"].get(b, []), key=lambda r: -r["__rn"])
        carry = (carry + own)[-before:] if before else []
    carry = []
    for b in reversed(ids):
        extra += [tuple(r[c] if c != BUCKET else b for c in columns) for r in carry]
        own = sorted(edges["head"].get(b, []), key=lambda r: r["__rn"])
        carry = (own + carry)[:after] if after else []
    main = o.df.withColumn(HALO, F.lit(False))
    if extra:
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in o.df.schema.fields])
        main = main.unionByName(spark.createDataFrame(extra, schema).withColumn(HALO, F.lit(True)))
    return Ordering(main, o.sort, o.rows, o.buckets)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(HALO)).drop(HALO, BUCKET)


def shifted(df: DataFrame, cols: list[str], order_by: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Add ``<c>__prev`` and ``<c>__next`` over the whole table's order."""
    o = with_halo(ordering(df, order_by, key), 1, 1)
    added = {}
    for c in cols:
        added[f"{c}__prev"] = F.lag(quoted(c)).over(o.window)
        added[f"{c}__next"] = F.lead(quoted(c)).over(o.window)
    return drop_halo(o.df.withColumns(added))


def bucket_offsets(o: Ordering, sums: dict[str, Column]) -> DataFrame:
    """One row per bucket with the totals of all earlier buckets, as ``<name>__before``.

    The table has one row per bucket (bounded by MAX_BUCKETS and the key sub-buckets), so
    broadcasting it is safe.
    """
    totals = o.df.groupBy(BUCKET).agg(*[F.sum(c).alias(n) for n, c in sums.items()]).collect()
    running = {n: 0 for n in sums}
    rows = []
    for r in sorted(totals, key=lambda r: r[BUCKET]):
        rows.append((r[BUCKET], *[running[n] for n in sums]))
        for n in sums:
            running[n] += r[n] or 0
    kinds = {n: ("long" if isinstance(running[n], int) else "double") for n in sums}
    rows = [(r[0], *[int(v) if kinds[n] == "long" else float(v) for n, v in zip(sums, r[1:])]) for r in rows]
    schema = f"{BUCKET} long, " + ", ".join(f"`{n}__before` {kinds[n]}" for n in sums)
    return F.broadcast(o.df.sparkSession.createDataFrame(rows, schema))


def with_row_index(
    df: DataFrame, order_by: Sequence[str], key: Sequence[str], name: str = "row_index", rows: int | None = None
) -> DataFrame:
    """Dense 0-based position of each row in the total order."""
    o = ordering(df, order_by, key, rows=rows)
    local = o.df.withColumn("__rn", F.row_number().over(o.window).cast("long"))
    if o.buckets == 1:
        return local.withColumn(name, F.col("__rn") - 1).drop("__rn", BUCKET)
    offsets = bucket_offsets(o, {"n": F.lit(1)})
    joined = local.join(offsets, BUCKET, "left")
    return joined.withColumn(name, F.col("n__before") + F.col("__rn") - 1).drop("__rn", "n__before", BUCKET)


def running_sum(
    df: DataFrame, sums: dict[str, Column], order_by: Sequence[str], key: Sequence[str]
) -> DataFrame:
    """Inclusive running sums over the whole table's order."""
    o = ordering(df, order_by, key)
    offsets = bucket_offsets(o, sums)
    frame = o.window.rowsBetween(Window.unboundedPreceding, 0)
    local = o.df.withColumns({f"__{n}": F.sum(c).over(frame) for n, c in sums.items()})
    out = local.join(offsets, BUCKET, "left")
    out = out.withColumns({n: F.col(f"__{n}") + F.col(f"{n}__before") for n in sums})
    return out.drop(BUCKET, *[f"__{n}" for n in sums], *[f"{n}__before" for n in sums])


def rolling_mean(
    df: DataFrame, col: str, order_by: Sequence[str], key: Sequence[str], size: int = 4, name: str = "rolling_mean"
) -> DataFrame:
    """Mean over the current row and the ``size - 1`` rows before it."""
    o = with_halo(ordering(df, order_by, key), size - 1, 0)
    frame = o.window.rowsBetween(-(size - 1), 0)
    return drop_halo(o.df.withColumn(name, F.avg(quoted(col)).over(frame)))


def streak(
    df: DataFrame, flag: Column, order_by: Sequence[str], key: Sequence[str], name: str = "streak"
) -> DataFrame:
    """Length of the run of true flags that ends at each row; unbounded look-back.

    Each bucket reports its size and its trailing run; runs that reach a bucket's start
    continue from the bucket before.
    """
    o = ordering(df, order_by, key)
    frame = o.window.rowsBetween(Window.unboundedPreceding, 0)
    local = o.df.withColumn("__rn", F.row_number().over(o.window).cast("long"))
    local = local.withColumn("__zero", F.max(F.when(~flag, F.col("__rn"))).over(frame))
    summary = local.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n"), F.max("__zero").alias("z")).collect()
    rows, carry = [], 0
    for r in sorted(summary, key=lambda r: r[BUCKET]):
        rows.append((r[BUCKET], carry))
        carry = r["n"] - r["z"] if r["z"] is not None else carry + r["n"]
    carried = F.broadcast(o.df.sparkSession.createDataFrame(rows, f"{BUCKET} long, __carry long"))
    out = local.join(carried, BUCKET, "left")
    run = F.when(F.col("__zero").isNull(), F.col("__rn") + F.col("__carry")).otherwise(F.col("__rn") - F.col("__zero"))
    return out.withColumn(name, run).drop(BUCKET, "__rn", "__zero", "__carry")


def value_prefix(
    df: DataFrame, columns: dict[str, Column], weights: dict[str, Column], *, max_buckets: int = MAX_BUCKETS, rows: int | None = None
) -> DataFrame:
    """Per column and distinct value: weight sums and the sums over all smaller values.

    Returns (column, value, <w>, <w>__before). Ties are collapsed by a map-side aggregate
    first, so a value shared by a third of all rows is one row afterwards.
    """
    names = list(columns)
    work = df.select(
        *[columns[n].cast("double").alias(f"v{i}") for i, n in enumerate(names)],
        *[w.alias(n) for n, w in weights.items()],
    )
    parallelism = df.sparkSession.sparkContext.defaultParallelism
    cuts: list[list[float]] = [[] for _ in names]
    if rows is None or bucket_count(rows, parallelism) > 1:
        grid = [i / max_buckets for i in range(1, max_buckets)] or [0.5]
        sketches = [F.percentile_approx(f"v{i}", prob_array(grid), 10_000).alias(f"q{i}") for i in range(len(names))]
        row = work.agg(F.count(F.lit(1)).alias("n"), *sketches).first()
        count = bucket_count(row["n"], parallelism)
        for i in range(len(names)):
            q = row[f"q{i}"] or []
            points = {q[round(j * len(grid) / count)] for j in range(1, count)} if q and count > 1 else set()
            cuts[i] = sorted(p for p in points if math.isfinite(p))
    work = bucketize(work, [f"v{i}" for i in range(len(names))], [f"b{i}" for i in range(len(names))], cuts)
    cells = F.array(*[
        F.struct(F.lit(n).alias("column"), F.col(f"v{i}").alias("value"), F.col(f"b{i}").cast("int").alias(BUCKET))
        for i, n in enumerate(names)
    ])
    long = work.select(F.explode(cells).alias("c"), *weights).select("c.*", *weights)
    values = (
        long.filter(F.col("value").isNotNull())
        .groupBy("column", BUCKET, "value")
        .agg(*[F.sum(w).alias(w) for w in weights])
    )
    frame = Window.partitionBy("column", BUCKET).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    local = values.withColumns({f"{w}__before": F.coalesce(F.sum(w).over(frame), F.lit(0)).cast("double") for w in weights})
    if not any(cuts):
        return local.drop(BUCKET)
    totals = values.groupBy("column", BUCKET).agg(*[F.sum(w).alias(w) for w in weights]).collect()
    starts_rows, running = [], {}
    for r in sorted(totals, key=lambda r: (r["column"], r[BUCKET])):
        state = running.setdefault(r["column"], dict.fromkeys(weights, 0.0))
        starts_rows.append((r["column"], r[BUCKET], *[float(state[w]) for w in weights]))
        for w in weights:
            state[w] += r[w] or 0
    schema = f"column string, {BUCKET} int, " + ", ".join(f"`{w}__start` double" for w in weights)
    starts = F.broadcast(df.sparkSession.createDataFrame(starts_rows, schema))  # columns x MAX_BUCKETS rows at most
    out = local.join(starts, ["column", BUCKET], "left")
    return out.select(
        "column", "value", *weights,
        *[(F.col(f"{w}__before") + F.col(f"{w}__start")).alias(f"{w}__before") for w in weights],
    )


def average_ranks(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Average rank (ties share the mean of their positions) per column and distinct value."""
    out = value_prefix(df, columns, {"n": F.lit(1)})
    return out.select("column", "value", "n", (F.col("n__before") + (F.col("n") + 1) / 2).alias("avg_rank"))
