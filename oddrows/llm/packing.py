"""Packing token pieces into fixed-length sequences: best fit decreasing, certified by lower bounds.

Pieces are dealt to partitions of bounded size, evenly over the lengths. Each partition runs best fit decreasing and computes
lower bounds from dual-feasible functions; if the best bound equals its bin count, the partition is certified. If the whole
layout needs more bins than the bound of the whole length histogram, partitions exchange documents: they give up every bin
with room and every bin of more than two pieces (pairs that fill a bin stay), also certified ones, as their bounds do not add
up to the whole's. What was given up is dealt anew to half as many partitions and packed again, and the new layout is taken
only if it has fewer bins. This ends when the bound is met or a partition would get ``GROWTH`` times its usual pieces.

Defined cases: a null text is empty (one token: the end id); rows that repeat a document are documents of their own; ties
in length are broken by the row's number; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddrows.llm.common import materialize, per_batch, text_of

CAPACITY = 2048
PIECES_PER_PARTITION = 16_384
GROWTH = 8
DEALT_ROWS = 1 << 20  # pieces that one task deals
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids binary"


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs; ``counts[x]`` pieces have length x. Exact integer arithmetic.

    Dual-feasible functions of x over the capacity C: the rounding u_k, and U_e, which lifts lengths above C - e to C
    and drops those below e, for every threshold e.
    """
    x = np.arange(capacity + 1, dtype=np.int64)
    counts = counts.astype(np.int64)
    best = -(-int((counts * x).sum()) // capacity)
    for k in range(1, 33):
        w = np.where(((k + 1) * x) % capacity == 0, k * x, capacity * ((k + 1) * x // capacity))
        best = max(best, -(-int((counts * w).sum()) // (capacity * k)))
    from_top, mass = np.cumsum(counts[::-1])[::-1], np.concatenate([[0], np.cumsum(counts * x)])
    e = np.arange(1, capacity // 2 + 1)
    middle = mass[capacity - e + 1] - mass[e]
    return max(best, int((from_top[capacity - e + 1] - (-middle // capacity)).max(initial=0)))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, and the number of bins. A piece goes to the open bin it fills best."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: dict[int, list[int]] = {}  # room left -> bins
    rooms, n = 0, 0  # bit r of rooms: some bin has room r
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            held = free[room]
            b = held.pop()
            if not held:
                rooms &= ~(1 << room)
        else:
            room, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - room
        room -= size
        if room:
            free.setdefault(room, []).append(b)
            rooms |= 1 << room
    return bins, offsets, n


def cut_pieces(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces; only the first may be shorter than the capacity when there are several."""
    first = n_ids % capacity or min(n_ids, capacity)
    starts = [0, *range(first, n_ids, capacity)] if n_ids else []
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n_ids])]


def tokenize_pieces(docs: DataFrame, encoder, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece; ``ids`` are little-endian unsigned 32-bit ids. ``encoder()`` gives a function from text to ids."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(np.asarray(encode(text.as_py()), dtype="<u4"), np.uint32(end_id)).astype("<u4")
                out += [(doc_id, k, a, n, ids[a : a + n].tobytes()) for k, (a, n) in enumerate(cut_pieces(len(ids), capacity))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

        yield from per_batch(run)(batches)

    return rows.mapInArrow(task, PIECE_SCHEMA)


def _histogram(df: DataFrame, capacity: int) -> np.ndarray:
    """Pieces by length: at most ``capacity`` rows reach the driver."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in df.groupBy("length").count().collect():
        counts[length] = n
    return counts


def _dealt(pieces: DataFrame, n: int, parts: int, seed: int) -> DataFrame:
    """``pieces`` with ``part``: a task deals its pieces in turn, in the order of their lengths, so all parts get about the same
    lengths. Which task a piece is in depends on its row number alone."""
    ordered = pieces.select("row", "length").repartition(max(1, math.ceil(n / DEALT_ROWS)), F.xxhash64("row", F.lit(seed))).sortWithinPartitions("length", "row")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = (TaskContext.get().partitionId() * 0x9E3779B1 + seed) % parts
        for batch in batches:
            part = (at + np.arange(batch.num_rows)) % parts
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], names=["row", "length", "part"])

    return ordered.mapInArrow(task, "row long, length long, part long")


def _pack_once(pieces: DataFrame, n: int, parts: int, seed: int, capacity: int) -> DataFrame:
    """Pack each part by itself; a piece knows whether its part is certified and whether its bin takes part in an exchange."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row"], ascending=[False, True], kind="stable")
        lengths = pdf["length"].to_numpy()
        bins, offsets, count = best_fit_decreasing(lengths, capacity)
        certified = count == lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        given = (np.bincount(bins, weights=lengths, minlength=count) < capacity) | (np.bincount(bins, minlength=count) > 2)
        sequence = (seed << 56) + (int(pdf["part"].iloc[0]) << 24) + bins
        return pd.DataFrame({"row": pdf["row"].to_numpy(), "length": lengths, "sequence_id": sequence, "offset": offsets, "given": given[bins], "certified": certified})

    return _dealt(pieces, n, parts, seed).groupBy("part").applyInPandas(pack, "row long, length long, sequence_id long, offset long, given boolean, certified boolean")


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_partition: int = PIECES_PER_PARTITION) -> DataFrame:
    """(row, sequence_id, offset) for ``pieces`` (row: unique long, length: 1 to ``capacity``)."""
    full = pieces.where(F.col("length") == capacity).select("row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity).select("row", F.col("length").cast("long").alias("length"))
    counts = _histogram(rest, capacity)
    n = int(counts.sum())
    if n == 0:
        return full
    bound = lower_bound(counts, capacity)
    parts, seed = math.ceil(n / per_partition), 0
    layout = materialize(_pack_once(rest, n, parts, seed, capacity))
    bins = layout.select("sequence_id").distinct().count()
    while bins > bound and parts > 1:
        given = layout.where("given")
        size, was = given.agg(F.count(F.lit(1)), F.count_distinct("sequence_id")).first()
        fewer = max(1, math.ceil(size / (GROWTH * per_partition)), min(parts // 2, math.ceil(size / per_partition)))
        if not size or fewer >= parts:
            break
        parts, seed = fewer, seed + 1
        again = materialize(_pack_once(given, size, parts, seed, capacity))
        now = again.select("sequence_id").distinct().count()
        if now < was:
            layout, bins = layout.where("not given").unionByName(again), bins - was + now
    return layout.select("row", "sequence_id", "offset").unionByName(full)


def numbered(pieces: DataFrame) -> DataFrame:
    """Pieces written once, each with a unique number ``row``."""
    return materialize(pieces.withColumn("row", F.monotonically_increasing_id()))


def place(pieces: DataFrame, capacity: int = CAPACITY, per_partition: int = PIECES_PER_PARTITION) -> DataFrame:
    """``pieces`` (as ``numbered`` gives them) with sequence_id and offset."""
    placed = pack(pieces.select("row", "length"), capacity, per_partition)
    return pieces.join(placed, "row").drop("row")


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ids (little-endian unsigned 32-bit) of the pieces in order. A group has at most
    ``capacity`` pieces."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
