"""Seeded picks, stratified caps and splits, contiguous blocks, top-k reports.

A pick of k of n rows takes the rows with the k smallest seeded hashes. The cut hash is an
exact order statistic, so the pick is a plain filter: no sort, no shuffle, no row moves.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddrows.functions.hashing import HEX_DIGITS, hash52
from oddrows.functions.schema import quoted
from oddrows.operators.ordered import with_row_index
from oddrows.operators.ranks import order_statistics


def injected_row_count(n: int, contamination: float) -> int:
    """ceil(n * contamination), at least 1 and at most n - 1; 0 when nothing can be injected."""
    if n < 2 or contamination <= 0:
        return 0
    return min(n - 1, max(1, math.ceil(n * contamination)))


def smallest_k(df: DataFrame, value: Column, k: int, n: int, key: list[str]) -> Column:
    """Predicate true on exactly the k rows with the smallest ``value`` (ties by key)."""
    if k <= 0:
        return F.lit(False)
    if k >= n:
        return value.isNotNull()
    cut = order_statistics(df, {"h": (value, [k - 1])}, counts={"h": n})["h"][k - 1]
    row = df.agg(F.count_if(value < F.lit(cut)).alias("below"), F.count_if(value == F.lit(cut)).alias("ties")).first()
    room = k - row["below"]
    if room >= row["ties"]:
        return value <= F.lit(cut)
    # Several rows share the cut hash (a 52-bit collision): keep the first ones by key.
    if row["ties"] > 10_000:
        raise ValueError("the key is not unique: too many rows share one hash")
    tied = df.filter(value == F.lit(cut)).select(*[quoted(c) for c in key]).orderBy(*[quoted(c) for c in key]).limit(room)
    hits = [F.struct(*[F.lit(v) for v in r]) for r in tied.collect()]
    return (value < F.lit(cut)) | ((value == F.lit(cut)) & F.struct(*[quoted(c) for c in key]).isin(hits))


def pick_condition(df: DataFrame, key: list[str], k: int, seed: int, n: int | None = None) -> Column:
    """Predicate for a seeded pick of k rows without replacement."""
    n = df.count() if n is None else n
    return smallest_k(df, hash52(seed, key), k, n, key)


def seeded_pick(df: DataFrame, key: list[str], k: int, seed: int = 42) -> DataFrame:
    return df.filter(pick_condition(df, key, k, seed))


def block_ranges(n: int, k: int, blocks: int, seed: int) -> list[tuple[int, int]]:
    """[start, end) positions of k rows in non-overlapping runs placed at random.

    The places come from md5 numbers of the seed and the block's number, so SQL can repeat them: each is a place among the
    rows that no block takes, and in their order the blocks push the rows after them on.
    """
    blocks = min(max(1, int(blocks)), k)
    sizes = [k // blocks + (1 if i < k % blocks else 0) for i in range(blocks)]
    free = max(0, n - k)
    drawn = [int(hashlib.md5(f"{seed}:block:{i}".encode()).hexdigest()[:HEX_DIGITS], 16) for i in range(blocks)]
    cuts = sorted(number * (free + 1) >> 4 * HEX_DIGITS for number in drawn)
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return [(int(c + o), int(c + o + s)) for c, o, s in zip(cuts, offsets, sizes)]


def contiguous_blocks(
    df: DataFrame, order_by: list[str], key: list[str], k: int, blocks: int, seed: int, name: str = "picked"
) -> DataFrame:
    """Add a boolean that marks k rows in ``blocks`` contiguous runs of the table's order."""
    n = df.count()
    ranges = block_ranges(n, k, blocks, seed) if k else []
    indexed = with_row_index(df, order_by, key, "__i")
    hit = F.lit(False)
    for start, end in ranges:
        hit = hit | ((F.col("__i") >= start) & (F.col("__i") < end))
    return indexed.withColumn(name, hit).drop("__i")


def class_counts(df: DataFrame, label: str, limit: int = 1000) -> dict:
    rows = df.groupBy(quoted(label).alias("y")).count().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{label!r} has more than {limit} classes")
    return {r["y"]: r["count"] for r in sorted(rows, key=lambda r: str(r["y"]))}


def _stratified(df: DataFrame, key: list[str], label: str, takes: dict, counts: dict, seed: int) -> Column:
    """Predicate picking ``takes[c]`` rows of each class by hash order, all classes in one pass."""
    value = hash52(seed, key)
    wanted = {c: min(takes[c], counts[c]) for c in counts if takes[c] > 0}
    partial = {c: t for c, t in wanted.items() if t < counts[c]}
    requests = {str(i): (F.when(quoted(label).eqNullSafe(F.lit(c)), value), [t - 1]) for i, (c, t) in enumerate(partial.items())}
    cuts = order_statistics(df, requests, counts={str(i): counts[c] for i, c in enumerate(partial)}) if partial else {}
    hit = F.lit(False)
    for c in wanted:
        same = quoted(label).eqNullSafe(F.lit(c))
        if c in partial:
            i = str(list(partial).index(c))
            hit = hit | (same & (value <= F.lit(cuts[i][partial[c] - 1])))
        else:
            hit = hit | same
    return hit


def stratified_cap(df: DataFrame, key: list[str], label: str, max_rows: int | None, seed: int = 42) -> DataFrame:
    """At most ``max_rows`` rows with class shares kept.

    Rounding may leave one or two rows too many or too few: the surplus is dropped from, or
    the shortfall added to, the sample by the same hash order (the rows not yet sampled are
    the anti-join side, expressed as the negated predicate).
    """
    counts = class_counts(df, label)
    n = sum(counts.values())
    if not max_rows or n <= max_rows:
        return df
    takes = {c: min(m, max(1, round(max_rows * m / n))) for c, m in counts.items()}
    hit = _stratified(df, key, label, takes, counts, seed)
    chosen = sum(takes.values())
    value = hash52(seed + 1, key)
    if chosen > max_rows:
        sample = df.filter(hit)
        return sample.filter(smallest_k(sample, value, max_rows, chosen, key))
    if chosen < max_rows:
        rest = df.filter(~hit)
        more = smallest_k(rest, value, max_rows - chosen, n - chosen, key)
        return df.filter(hit | more)
    return df.filter(hit)


def not_sampled(df: DataFrame, sample: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``df`` whose key is not in ``sample``."""
    return df.join(sample.select(*[quoted(k) for k in key]), key, "left_anti")


def stratified_split(
    df: DataFrame, key: list[str], label: str, test_size: float, seed: int = 42, *, min_rows: int = 40, name: str = "fold"
) -> DataFrame | None:
    """Add 'train'/'test' keeping class shares, or None when the labels cannot be split."""
    counts = class_counts(df, label)
    n = sum(counts.values())
    if len(counts) < 2 or min(counts.values()) < 2 or n < min_rows:
        return None
    takes = split_sizes(counts, test_size)
    hit = _stratified(df, key, label, takes, counts, seed)
    return df.withColumn(name, F.when(hit, F.lit("test")).otherwise(F.lit("train")))


def split_sizes(counts: dict, test_size: float) -> dict:
    """Test rows per class: ceil(n * share) in all, by largest remainder, one of each class."""
    n = sum(counts.values())
    total = math.ceil(n * test_size)
    exact = {c: m * total / n for c, m in counts.items()}
    takes = {c: math.floor(x) for c, x in exact.items()}
    for c in sorted(exact, key=lambda c: (takes[c] - exact[c], str(c)))[: total - sum(takes.values())]:
        takes[c] += 1
    return {c: min(max(1, t), counts[c] - 1) for c, t in takes.items()}


def random_split(df: DataFrame, key: list[str], test_size: float, seed: int = 42, name: str = "fold") -> DataFrame:
    """Shuffle by hash and cut at 1 - test_size."""
    n = df.count()
    train = round(n * (1.0 - test_size))
    hit = smallest_k(df, hash52(seed, key), train, n, key)
    return df.withColumn(name, F.when(hit, F.lit("train")).otherwise(F.lit("test")))


def top_rows(df: DataFrame, score: str, key: list[str], k: int = 10) -> DataFrame:
    """The k highest scores with their keys and ranks (a top-k report of fixed size)."""
    top = df.select(*[quoted(c) for c in key], quoted(score)).orderBy(F.desc(score), *[quoted(c) for c in key]).limit(k)
    cells = F.array_sort(F.collect_list(F.struct((-quoted(score)).alias("__neg"), *[quoted(c) for c in key], quoted(score))))
    return top.agg(cells.alias("x")).select(F.posexplode("x")).select(
        *[F.col("col")[c].alias(c) for c in key], F.col("col")[score].alias(score), (F.col("pos") + 1).alias("rank")
    )


def preview_head(df: DataFrame, order_by: list[str], n: int = 20) -> DataFrame:
    """First 1 to 80 rows in order."""
    return df.orderBy(*[quoted(c) for c in order_by]).limit(max(1, min(int(n), 80)))
