"""Exact k-nearest-neighbour self join.

1. Equal vectors are collapsed to one weighted point, so a vector shared by a third of
   all rows is a single point.
2. Points are assigned to their nearest pivot (about sqrt(n) pivots, sampled by hash), and
   cells are cut into rings of bounded size by distance to the pivot, then by hash.
3. A block's own matrix gives each point an upper bound on its k-th distance, and the block
   names the blocks that the triangle inequality and the bisector planes cannot rule out, so
   nothing is missed. Each named block sends it those of its points that are near enough.
4. A block's task keeps the k best candidates of each of its points and streams what was sent,
   the nearest cells first. As the k-th distances shrink, points skip cells out of their reach, and of
   the rest one product in single precision, compared with each point's reach less the rounding that it
   may have, leaves few pairs: only these are measured exactly.

So exactly k edges a point leave the tasks and none is shuffled, whatever the dimension. No step
holds more than one bounded block pair and the block's k best in memory. Ties go to the point
with the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddrows.functions.schema import quoted
from oddrows.operators.blocks import column_matrix, matrix_column, task_partitions
from oddrows.session import keep

MAX_BLOCK = 16_384  # larger blocks are sent fewer copies of the other points
MIN_BLOCK = 256
PIVOT_BYTES = 32 << 20  # what one broadcast of pivots may take
MAX_PIVOTS = 4096
RINGS = 31
CELLS = 1 << 21  # distances that a task holds at once (16 MB)


@dataclass
class Layout:
    """Driver-side picture of the cells and their blocks; bounded by MAX_PIVOTS x RINGS."""

    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray
    reach: np.ndarray
    between: np.ndarray
    base: np.ndarray
    edges: list[np.ndarray]
    splits: np.ndarray

    def blocks_of(self, cell: np.ndarray, distance: np.ndarray, salt: np.ndarray) -> np.ndarray:
        out = np.empty(len(cell), dtype=np.int64)
        for c in np.unique(cell):
            at = cell == c
            ring = np.searchsorted(self.edges[c], distance[at], side="right")
            out[at] = self.base[c] + ring * self.splits[c] + salt[at] % self.splits[c]
        return out

    def targets(self, c: int, near: np.ndarray, bound: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(block, mask of points) for the rings of cell ``c`` within ``bound`` of each point."""
        edges = self.edges[c]
        lows = np.concatenate([[self.low[c]], edges])
        highs = np.concatenate([edges, [self.high[c]]])
        for r in range(len(lows)):
            mask = (near - bound <= highs[r]) & (near + bound >= lows[r])
            if mask.any():
                for s in range(self.splits[c]):
                    yield int(self.base[c] + r * self.splits[c] + s), mask


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by the inner-product form; good to a few units of ``slack``."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0, out=d)


def slack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rounding bound of ``squared`` per row of ``a``."""
    top = (b * b).sum(1).max() if len(b) else 0.0
    return 16.0 * np.finfo(float).eps * (a.shape[1] + 4) * ((a * a).sum(1) + top)


def nearest_in_block(qid: np.ndarray, q: np.ndarray, sid: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query index, point index, exact distance) of the k nearest other points in one block.

    The fast form proposes every candidate that rounding could place in the top k; their
    distances are then recomputed from the differences.
    """
    d = squared(q, s)
    d[qid[:, None] == sid[None, :]] = np.inf
    take = min(k, len(sid))
    kth = np.partition(d, take - 1, axis=1)[:, take - 1]
    keep_mask = (d <= (kth + 2.0 * slack(q, s))[:, None]) & np.isfinite(d)
    qi, si = np.nonzero(keep_mask)
    exact = np.empty(len(qi))
    for at in range(0, len(qi), 200_000):
        gap = q[qi[at: at + 200_000]] - s[si[at: at + 200_000]]
        exact[at: at + 200_000] = np.sqrt((gap * gap).sum(1))
    order = np.lexsort((sid[si], exact, qi))
    qi, si, exact = qi[order], si[order], exact[order]
    starts = np.searchsorted(qi, np.arange(len(qid)))
    rank = np.arange(len(qi)) - starts[qi]
    best = rank < k
    return qi[best], si[best], exact[best]


def packed(x: np.ndarray) -> bytes:
    """A matrix as bytes, in single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    return short.tobytes() if np.array_equal(short, x) else np.ascontiguousarray(x, dtype=np.float64).tobytes()


def matrix(data: pa.Buffer, rows: int, width: int) -> np.ndarray:
    """The matrix of ``packed``."""
    kind = np.float64 if len(data) == 8 * rows * width else np.float32
    return np.frombuffer(data, kind).astype(np.float64, copy=False).reshape(rows, width)


def buffers(batch: pa.RecordBatch) -> Iterator[list]:
    """The rows of a batch one by one, binaries as buffers: nothing but the row at hand is copied."""
    for i in range(batch.num_rows):
        yield [c[i].as_buffer() if pa.types.is_binary(c.type) else c[i].as_py() for c in batch.columns]


def distinct_points(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """(gid, w, v): one point per distinct vector, named by its smallest key."""
    v = F.array(*[quoted(f).cast("double") for f in features])
    return df.groupBy(v.alias("v")).agg(F.min(quoted(key)).cast("long").alias("gid"), F.count(F.lit(1)).alias("w"))


def neighbour_edges(points: DataFrame, k: int, width: int, *, block: int | None = None, pivots: int | None = None) -> DataFrame:
    """(gid, nbr, distance, rank): the k nearest other points of each point."""
    spark = points.sparkSession
    n = points.count()
    if n <= 1:
        return spark.createDataFrame([], "gid long, nbr long, distance double, rank int")
    parallel = spark.sparkContext.defaultParallelism
    block = block or max(MIN_BLOCK, min(MAX_BLOCK, math.ceil(n / (2 * parallel))))
    limit = min(MAX_PIVOTS, max(1, PIVOT_BYTES // (8 * width)))
    wanted = pivots or (1 if n <= block else min(limit, max(1, math.isqrt(n) // 4, math.ceil(n / block / 8))))
    picked = _pivots(points, n, wanted, limit)
    assigned = keep(_assign(points, picked, width))
    layout = _layout(assigned, picked, k, block)
    shared = spark.sparkContext.broadcast(vars(layout))  # at most MAX_PIVOTS x (vector + RINGS) numbers, plus their distances
    blocks = keep(_pack_blocks(assigned, shared, k, width, max(task_partitions(spark, math.ceil(n / block) * 4), math.ceil(n / block))))
    # More points make more tasks: what one of them reads does not grow with the number of blocks that it serves.
    parts = max(task_partitions(spark, math.ceil(n / block) * 4), math.ceil(n / block) * 2)
    asked = _asked(blocks, shared, width)
    sent = asked.repartition(parts, "target").join(blocks.select(F.col("block").alias("target"), F.col("cell").alias("s_cell"), F.col("ids").alias("s_ids"), F.col("x").alias("s_x")), "target")
    sent = _sent(sent, shared, width)
    own = blocks.select(F.col("block").alias("home"), F.lit(-1.0).alias("far"), F.lit(-1).cast("long").alias("target"), "cell", "ids", "x", "bound")
    return _streamed(own.unionByName(sent.withColumn("bound", F.lit(None).cast("binary"))), shared, k, width, parts)


def _pivots(points: DataFrame, n: int, wanted: int, limit: int) -> np.ndarray:
    """About ``wanted`` points chosen by hash; never more than ``limit`` reach the driver."""
    span = 1 << 30
    cut = max(1, math.ceil(span * wanted / n))
    hashed = F.pmod(F.xxhash64("gid", F.lit("pivot")), F.lit(span))
    rows = points.filter(hashed < cut).select("gid", "v").orderBy("gid").limit(limit).collect()
    if not rows:
        rows = points.select("gid", "v").orderBy("gid").limit(1).collect()
    return np.array([r["v"] for r in rows], dtype=float)


def _assign(points: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """(gid, w, cell, distance, x) with the vector as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            cell = squared(x, pivots).argmin(1)
            gap = x - pivots[cell]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(np.sqrt((gap * gap).sum(1))), matrix_column(x)],
                names=["gid", "w", "cell", "distance", "x"],
            )

    return points.select("gid", "w", "v").mapInArrow(run, "gid long, w long, cell int, distance double, x binary")


def _layout(assigned: DataFrame, pivots: np.ndarray, k: int, block: int) -> Layout:
    probs = F.expr("array(" + ", ".join(f"{i / (RINGS + 1)!r}D" for i in range(1, RINGS + 1)) + ")")
    stats = assigned.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("distance").alias("a"), F.max("distance").alias("b"),
        F.percentile_approx("distance", probs, 1000).alias("q"),
    ).collect()
    size = len(pivots)
    count, low, high = np.zeros(size, dtype=np.int64), np.full(size, np.inf), np.full(size, -np.inf)
    edges: list[np.ndarray] = [np.array([]) for _ in range(size)]
    splits, base, at = np.ones(size, dtype=np.int64), np.zeros(size, dtype=np.int64), 0
    for r in sorted(stats, key=lambda r: r["cell"]):
        c = r["cell"]
        count[c], low[c], high[c] = r["n"], r["a"], r["b"]
        parts = math.ceil(r["n"] / block)
        if parts > 1:
            rings = min(parts, RINGS + 1)
            q = np.array(r["q"], dtype=float)
            cuts = np.unique(q[(np.arange(1, rings) * (RINGS + 1)) // rings - 1])
            edges[c] = cuts[(cuts > r["a"]) & (cuts < r["b"])]
            splits[c] = math.ceil(parts / (len(edges[c]) + 1))
        base[c] = at
        at += (len(edges[c]) + 1) * splits[c]
    # Tolerances keep every bound on the safe side of rounding.
    scale = 1e-9 * (1.0 + np.abs(pivots).max())
    between = np.sqrt(squared(pivots, pivots)) if size > 1 else np.zeros((1, 1))
    reach = np.full(size, np.inf)
    for c in range(size):
        far = between[c] + np.where(count > 0, high, np.inf)
        order = np.argsort(far)
        enough = np.searchsorted(np.cumsum(count[order]), k + 1)
        if enough < size:
            reach[c] = far[order[enough]] + scale
    return Layout(pivots, low - scale, high + scale, reach, between, base, edges, splits)


def _pack_blocks(assigned: DataFrame, shared, k: int, width: int, parts: int) -> DataFrame:
    """One row per block: ids, matrix, cell and each point's bound on its k-th distance."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = Layout(**shared.value)
        for batch in batches:
            if batch.num_rows:
                salt = np.abs((batch.column(0).to_numpy() * np.int64(2654435761)) >> 7)
                b = layout.blocks_of(batch.column(2).to_numpy(), batch.column(3).to_numpy(), salt)
                yield pa.RecordBatch.from_arrays([pa.array(b), batch.column(0), batch.column(2), batch.column(3), batch.column(4)],
                                                 names=["block", "gid", "cell", "distance", "x"])

    def pack(table: pa.Table) -> pa.Table:
        layout = Layout(**shared.value)
        table = table.combine_chunks().sort_by("gid")
        ids = table.column("gid").to_numpy()
        x = column_matrix(table.column("x"), width)
        cell = table.column("cell")[0].as_py()
        bound = table.column("distance").to_numpy() + layout.reach[cell]
        if len(ids) > k:
            step = max(1, CELLS // len(ids))
            for at in range(0, len(ids), step):
                part = x[at: at + step]
                d = squared(part, x)
                d[np.arange(len(part)), at + np.arange(len(part))] = np.inf
                d.partition(k - 1, axis=1)
                bound[at: at + step] = np.minimum(bound[at: at + step], np.sqrt(d[:, k - 1] + 2.0 * slack(part, x)))
        return pa.table({
            "block": pa.array([table.column("block")[0].as_py()], pa.int64()), "cell": pa.array([cell], pa.int32()),
            "ids": pa.array([ids.tobytes()], pa.binary()), "x": pa.array([packed(x)], pa.binary()),
            "bound": pa.array([bound.tobytes()], pa.binary()),
        })

    placed = assigned.mapInArrow(place, "block long, gid long, cell int, distance double, x binary")
    return placed.repartition(parts, "block").groupBy("block").applyInArrow(pack, "block long, cell int, ids binary, x binary, bound binary")


def _asked(blocks: DataFrame, shared, width: int) -> DataFrame:
    """(target, home, h_cell, reach): blocks that may hold neighbours of a block's points. ``reach``: how far from the home
    cell's pivot such a neighbour can lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = Layout(**shared.value)
        for batch in batches:
            for block, own, ids, x, bound in buffers(batch):
                found = list(targets(layout, block, own, matrix(x, len(ids) // 8, width), np.frombuffer(bound)))
                for at in range(0, len(found), 4096):
                    part = found[at: at + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([t for t, _ in part], pa.int64()), pa.array([block] * len(part), pa.int64()), pa.array([own] * len(part), pa.int32()),
                         pa.array([r for _, r in part], pa.float64())], names=["target", "home", "h_cell", "reach"])

    def targets(layout: Layout, block: int, own: int, x: np.ndarray, bound: np.ndarray) -> Iterator[tuple[int, float]]:
        fuzz = np.sqrt(slack(x, layout.pivots))
        wide = bound + fuzz
        to_own = distances(x, layout.pivots[own])
        for c in np.flatnonzero(np.isfinite(layout.low)):
            near = distances(x, layout.pivots[c])
            rows = np.flatnonzero(in_reach(layout, own, c, near, to_own, wide, fuzz))
            if len(rows):
                for target, mask in layout.targets(c, near[rows], wide[rows]):
                    if target != block:
                        at = rows[mask]
                        yield target, float((to_own[at] + wide[at] + fuzz[at]).max())

    return blocks.select("block", "cell", "ids", "x", "bound").mapInArrow(run, "target long, home long, h_cell int, reach double")


def distances(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    gap = x - point
    return np.sqrt((gap * gap).sum(1))


def in_reach(layout: Layout, own: int, c: int, near: np.ndarray, to_own: np.ndarray, radius: np.ndarray, fuzz: np.ndarray) -> np.ndarray:
    """Which points of cell ``own`` may have a neighbour within ``radius`` in cell ``c``, by their distances to both pivots."""
    hit = (near - radius <= layout.high[c]) & (near + radius >= layout.low[c])
    gap = layout.between[own, c]
    if gap > 0:  # points of cell c lie beyond the plane halfway to its pivot
        hit &= (near * near - to_own * to_own) / (2.0 * gap) <= radius + (fuzz * fuzz) / gap
    return hit


def _sent(pairs: DataFrame, shared, width: int) -> DataFrame:
    """(home, far, target, cell, ids, x): the points of each asked block that lie within the home's reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = Layout(**shared.value)
        for batch in batches:
            for target, home, own, reach, cell, ids, x in buffers(batch):
                m = matrix(x, len(ids) // 8, width)
                near = np.flatnonzero(distances(m, layout.pivots[own]) <= reach)
                if len(near):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([home], pa.int64()), pa.array([float(layout.between[own, cell])]), pa.array([target], pa.int64()), pa.array([cell], pa.int32()),
                         pa.array([np.frombuffer(ids, np.int64)[near].tobytes()], pa.binary()), pa.array([packed(m[near])], pa.binary())],
                        names=["home", "far", "target", "cell", "ids", "x"])

    return pairs.select("target", "home", "h_cell", "reach", "s_cell", "s_ids", "s_x").mapInArrow(run, "home long, far double, target long, cell int, ids binary, x binary")


class Nearest:
    """The k best candidates so far of each point of a block, by distance, then id. ``radius`` bounds each point's k-th distance."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, bound: np.ndarray | None = None) -> None:
        self.ids, self.x, self.k = ids, x, k
        self.distance, self.neighbour = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.radius = np.full(len(ids), np.inf) if bound is None else bound.copy()
        self.squares = (x * x).sum(1)
        self.waiting: list[tuple[np.ndarray, ...]] = []  # (point, distance, neighbour) that are not among the k best yet
        self.held = 0

    def meet(self, rows: np.ndarray, s_ids: np.ndarray, s: np.ndarray) -> None:
        if not len(rows) or not len(s_ids):
            return
        squares = (s * s).sum(1)
        top = squares.max()
        kind = np.float32 if self.squares.max() + top < 1e30 else np.float64
        # x s - s s / 2 >= (x x - r r) / 2 says that s is within r of x; ``loss`` bounds what rounding may do to its double.
        right = np.column_stack([s, squares / -2.0]).astype(kind)
        step = max(1, CELLS // len(s_ids))
        for at in range(0, len(rows), step):
            part = rows[at: at + step]
            loss = 4.0 * np.finfo(kind).eps * (s.shape[1] + 4) * (self.squares[part] + top)
            reach = self.radius[part]
            with np.errstate(over="ignore"):
                limit = ((self.squares[part] - reach * reach - loss) / 2.0).astype(kind)
            hit = np.column_stack([self.x[part], np.ones(len(part))]).astype(kind) @ right.T >= np.nextafter(limit, kind(-np.inf))[:, None]
            if np.count_nonzero(hit) > 4 * self.k * len(part):
                qi, si, d = nearest_in_block(self.ids[part], self.x[part], s_ids, s, self.k)
            else:
                qi, si = np.divmod(np.flatnonzero(hit), len(s_ids))
                other = self.ids[part[qi]] != s_ids[si]
                qi, si = qi[other], si[other]
                d = np.empty(len(qi))
                for a in range(0, len(qi), 100_000):
                    gap = self.x[part[qi[a: a + 100_000]]] - s[si[a: a + 100_000]]
                    d[a: a + 100_000] = np.sqrt((gap * gap).sum(1))
            near = d <= reach[qi]
            self.waiting.append((part[qi[near]], d[near], s_ids[si[near]]))
            self.held += len(self.waiting[-1][0])
            if self.held >= len(self.ids) * self.k:
                self.merge()

    def merge(self) -> None:
        """What waits takes its place among the k best."""
        if not self.held:
            return
        point, d, nbr = (np.concatenate(c) for c in zip(*self.waiting))
        self.waiting, self.held = [], 0
        near = d <= self.radius[point]
        point, d, nbr = point[near], d[near], nbr[near]
        rows, mine = np.unique(point, return_inverse=True)
        row = np.concatenate([np.repeat(np.arange(len(rows)), self.k), mine])
        distance, neighbour = np.concatenate([self.distance[rows].ravel(), d]), np.concatenate([self.neighbour[rows].ravel(), nbr])
        order = np.lexsort((neighbour, distance, row))
        row = row[order]
        best = order[np.arange(len(row)) - np.searchsorted(row, np.arange(len(rows)))[row] < self.k]
        self.distance[rows], self.neighbour[rows] = distance[best].reshape(-1, self.k), neighbour[best].reshape(-1, self.k)
        self.radius[rows] = np.minimum(self.radius[rows], self.distance[rows, -1])

    def edges(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        step = max(1, 100_000 // self.k)
        for at in range(0, len(self.ids), step):
            d = self.distance[at: at + step]
            real = np.isfinite(d).ravel()
            gid, rank = np.repeat(self.ids[at: at + step], self.k), np.tile(np.arange(1, self.k + 1, dtype=np.int32), len(d))
            yield pa.RecordBatch.from_arrays(
                [pa.array(gid[real]), pa.array(self.neighbour[at: at + step].ravel()[real]), pa.array(d.ravel()[real]), pa.array(rank[real])],
                names=["gid", "nbr", "distance", "rank"])


def _streamed(rows: DataFrame, shared, k: int, width: int, parts: int) -> DataFrame:
    ordered = rows.repartition(parts, "home").sortWithinPartitions("home", "far", "target")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = Layout(**shared.value)
        now = None
        for batch in batches:
            for home, far, _, cell, ids, x, bound in buffers(batch):
                s_ids, s = np.frombuffer(ids, np.int64), matrix(x, len(ids) // 8, width)
                if far < 0:  # the block itself comes first
                    if now is not None:
                        yield from now.edges()
                    now, own = Nearest(s_ids, s, k, np.frombuffer(bound)), cell
                    fuzz, to_own = np.sqrt(slack(s, layout.pivots)), distances(s, layout.pivots[cell])
                    now.meet(np.arange(len(s_ids)), s_ids, s)
                else:
                    near = distances(now.x, layout.pivots[cell])
                    now.meet(np.flatnonzero(in_reach(layout, own, cell, near, to_own, now.radius + fuzz, fuzz)), s_ids, s)
        if now is not None:
            yield from now.edges()

    return ordered.mapInArrow(run, "gid long, nbr long, distance double, rank int")
