"""Exact order statistics and quantiles without a sort or a shuffle of rows.

Small tables use Spark's exact ``percentile`` in one aggregate. Larger ones take three passes, whatever the number of
ranks, columns and rows: one sketch a column, of drawn rows of a bounded number, gives cuts, one map-side count of all of
each column's cells between cuts tells in which cell a rank lies, and only those cells' values are gathered, each cell by
itself, to pick the rank. Every cut value has a cell of its own, so heavy ties are found by their count. A cell that is still
too large is cut again. The draw only places the cuts: ranks are counted over all rows, so the values do not depend on it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT_AGG_LIMIT = 200_000  # rows of a table for the one-pass exact aggregate
INNER_LIMIT = 100_000  # values one cell may leave for the final array
ACCURACY = 10_000
CELLS_AT_ONCE = 64  # cells that one pass reads
CUTS = 1_000  # cells a cell is cut into
DRAWN = 64 * CUTS  # values of a cell that place its cuts


def prob_array(probs: Sequence[float]) -> Column:
    """Literal array of probabilities, parsed in the JVM in one call."""
    return F.expr("array(" + ", ".join(f"{float(p)!r}D" for p in probs) + ")")


def _named(columns: Mapping[str, Column] | Sequence[str]) -> dict[str, Column]:
    if isinstance(columns, Mapping):
        return dict(columns)
    return {c: F.col(f"`{c}`") for c in columns}


def order_statistics(
    df: DataFrame,
    requests: Mapping[str, tuple[Column, Sequence[int]]],
    *,
    counts: Mapping[str, int] | None = None,
    inner_limit: int = INNER_LIMIT,
) -> dict[str, dict[int, float]]:
    """Values at the given 0-based ascending ranks of each expression (nulls ignored)."""
    names = list(requests)
    work = df.select(*[requests[n][0].cast("double").alias(f"v{i}") for i, n in enumerate(names)])
    if counts is None:
        row = work.agg(*[F.count(f"v{i}").alias(f"v{i}") for i in range(len(names))]).first()
        counts = {n: row[f"v{i}"] for i, n in enumerate(names)}
    found: dict[str, dict[int, float]] = {n: {} for n in names}
    # Open cells [lo, hi) of column i: values below it, values in it, wanted ranks. A NaN as hi: no upper end.
    inf = math.inf
    cells = [
        (i, -inf, math.nan, 0, counts[n], sorted({r for r in requests[n][1] if 0 <= r < counts[n]}))
        for i, n in enumerate(names)
    ]
    cells = [c for c in cells if c[5]]
    while cells:
        small, large = [c for c in cells if c[4] <= inner_limit], [c for c in cells if c[4] > inner_limit]
        for cell, picked in _picked(work, small):
            for rank, value in zip(cell[5], picked):
                found[names[cell[0]]][rank] = value
        if not large:
            break
        cells = []
        for i, lo, hi, below, n, ranks in _cut(work, large):
            if hi == math.nextafter(lo, inf) or not lo < inf:  # one value only
                found[names[i]].update(dict.fromkeys(ranks, lo))
            else:
                cells.append((i, lo, hi, below, n, ranks))
    return found


def _members(work: DataFrame, cells: list[tuple]) -> DataFrame:
    """(cell, v): the values of the given cells, read in one pass."""
    bounds = [(i, lo, hi) for i, lo, hi, *_ in cells]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {i: batch.column(i).drop_null().to_numpy(zero_copy_only=False) for i in {b[0] for b in bounds}}
            held = [columns[i][~(columns[i] < lo) if math.isnan(hi) else (columns[i] >= lo) & (columns[i] < hi)] for i, lo, hi in bounds]
            at = np.repeat(np.arange(len(held), dtype=np.int32), [len(v) for v in held])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.concatenate(held))], names=["cell", "v"])

    return work.mapInArrow(task, "cell int, v double")


def _counted(work: DataFrame, splits: Mapping[int, list[float]]) -> dict[int, dict[int, int]]:
    """How many values of each column lie between its splits, then how many are infinite and NaN, as in Spark's order; a task
    counts all it reads, so no value leaves it."""
    edges = {i: np.array(s) for i, s in splits.items()}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {i: np.zeros(len(e) + 1, np.int64) for i, e in edges.items()}
        for batch in batches:
            for i, e in edges.items():
                v = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                at = np.searchsorted(e, v, side="right") - 1
                at[np.isnan(v)] = len(e)
                counts[i] += np.bincount(at, minlength=len(e) + 1)
        for i, c in counts.items():
            b = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), i, np.int32)), pa.array(b.astype(np.int32)), pa.array(c[b])], names=["i", "b", "n"])

    sizes: dict[int, dict[int, int]] = {i: {} for i in splits}
    for r in work.mapInArrow(task, "i int, b int, n long").groupBy("i", "b").agg(F.sum("n").alias("n")).collect():
        sizes[r["i"]][r["b"]] = r["n"]
    return sizes


def _picked(work: DataFrame, cells: list[tuple]) -> list[tuple[tuple, list[float]]]:
    """The values at the wanted ranks of small cells. A cell's array is sorted by itself; only the picks leave it."""
    out = []
    for begin in range(0, len(cells), CELLS_AT_ONCE):
        part = cells[begin : begin + CELLS_AT_ONCE]
        wanted = F.create_map(*[x for at, c in enumerate(part) for x in (F.lit(at), F.array(*[F.lit(r - c[3]) for r in c[5]]))])
        arrays = _members(work, part).groupBy("cell").agg(F.sort_array(F.collect_list("v")).alias("s"))
        picks = arrays.select("cell", F.transform(wanted[F.col("cell")], lambda r: F.get("s", r)).alias("p")).collect()
        out += [(part[r["cell"]], list(r["p"])) for r in picks]
    return out


def _cut(work: DataFrame, cells: list[tuple]) -> list[tuple]:
    """The smaller cells that hold the wanted ranks of large ones."""
    inf = math.inf
    grid = prob_array([k / CUTS for k in range(CUTS + 1)])
    cuts: dict[int, set[float]] = {}
    for begin in range(0, len(cells), CELLS_AT_ONCE):
        part = cells[begin : begin + CELLS_AT_ONCE]
        share = DRAWN / min(c[4] for c in part)
        drawn = work if share >= 1 else work.where(F.rand(7) < share)
        for r in _members(drawn, part).groupBy("cell").agg(F.percentile_approx("v", grid, ACCURACY).alias("q")).collect():
            i, lo, hi = part[r["cell"]][:3]
            cuts.setdefault(i, set()).update({lo, hi}, r["q"], (math.nextafter(q, inf) for q in r["q"]))
    splits = {i: sorted({-inf, inf, *(x for x in c if not math.isnan(x))}) for i, c in cuts.items()}
    columns, sizes = sorted(splits), _counted(work, splits)
    out = []
    for i in columns:
        todo = sorted(rank for c in cells if c[0] == i for rank in c[5])
        below = 0
        for b in sorted(sizes[i]):
            n = sizes[i][b]
            mine = [rank for rank in todo if below <= rank < below + n]
            if mine:
                ends = [*splits[i][b : b + 2], math.nan, math.nan]
                out.append((i, ends[0], ends[1], below, n, mine))
            below += n
    return out


def quantiles(
    df: DataFrame,
    columns: Mapping[str, Column] | Sequence[str],
    probs: Sequence[float],
    *,
    rows: int | None = None,
    exact_agg_limit: int | None = None,
    inner_limit: int = INNER_LIMIT,
) -> dict[str, list[float | None]]:
    """Linearly interpolated exact quantiles of each column, nulls ignored.

    ``rows`` is an upper bound on the row count when the caller knows one.
    """
    return quantiles_with(df, columns, probs, {}, rows=rows, exact_agg_limit=exact_agg_limit, inner_limit=inner_limit)[0]


def quantiles_with(
    df: DataFrame,
    columns: Mapping[str, Column] | Sequence[str],
    probs: Sequence[float],
    extra: Mapping[str, Column],
    *,
    rows: int | None = None,
    exact_agg_limit: int | None = None,
    inner_limit: int = INNER_LIMIT,
) -> tuple[dict[str, list[float | None]], dict]:
    """Quantiles and other aggregates, in one pass when the table is small."""
    exprs = _named(columns)
    names = list(exprs)
    if rows is None:
        rows = df.count()
    limit = EXACT_AGG_LIMIT if exact_agg_limit is None else exact_agg_limit
    others = [c.alias(n) for n, c in extra.items()]
    if rows <= limit:
        array = prob_array(probs)
        row = df.agg(*[F.percentile(exprs[n].cast("double"), array).alias(f"__q{i}") for i, n in enumerate(names)], *others).first()
        found = {n: list(row[f"__q{i}"]) if row[f"__q{i}"] is not None else [None] * len(probs) for i, n in enumerate(names)}
        return found, {n: row[n] for n in extra}
    counts_row = df.agg(*[F.count(exprs[n]).alias(f"c{i}") for i, n in enumerate(names)], *others).first()
    counts = {n: counts_row[f"c{i}"] for i, n in enumerate(names)}
    wanted = {}
    for n in names:
        ranks = set()
        for p in probs:
            position = p * (counts[n] - 1)
            ranks |= {math.floor(position), math.ceil(position)}
        wanted[n] = (exprs[n], sorted(ranks))
    values = order_statistics(df, wanted, counts=counts, inner_limit=inner_limit)
    out: dict[str, list[float | None]] = {}
    for n in names:
        if counts[n] == 0:
            out[n] = [None] * len(probs)
            continue
        out[n] = []
        for p in probs:
            position = p * (counts[n] - 1)
            low = values[n][math.floor(position)]
            high = values[n][math.ceil(position)]
            out[n].append(low + (high - low) * (position - math.floor(position)))
    return out, {n: counts_row[n] for n in extra}


def kth_largest(df: DataFrame, column: Column, k: int, rows: int) -> float:
    """The k-th largest non-null value."""
    return order_statistics(df, {"v": (column, [rows - k])}, counts={"v": rows})["v"][rows - k]
