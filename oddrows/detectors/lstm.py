"""Recurrent autoencoder over row windows.

Rows are packed, in table order, into blocks that carry the neighbouring rows a window may
reach. Every window is trained in exactly one block, and each block scores its own rows
from all windows that cover them, so windows are never stored and edges never lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from oddrows.detectors.gradient import Adam, adam, uniform_start, unpack
from oddrows.functions.schema import quoted
from oddrows.operators.blocks import batch_matrix, block_sums, task_partitions
from oddrows.operators.ordered import BUCKET, HALO, ordering, with_halo
from oddrows.session import keep

EPOCHS = 15
BLOCK_ROWS = 2048
CHUNK = 256  # windows whose states stay in a core's cache
SEQUENCE_SCHEMA = "start int, own int, ids binary, x binary"


def pack_sequences(
    df: DataFrame, key: str, features: Sequence[str], order_by: Sequence[str], reach: int, *, rows: int = BLOCK_ROWS, buckets: int | None = None,
    total: int | None = None,
) -> DataFrame:
    """Ordered blocks of up to ``rows`` own rows with ``reach`` rows of context on each side.

    One shuffle by bucket; the rows of a bucket stream through in order, so a task holds one
    block and its context whatever the bucket's size. Buckets are few and fall together in tasks,
    so the blocks, which need no neighbour any more, are then dealt out evenly for the passes.
    """
    o = with_halo(ordering(df, order_by, [key], buckets=buckets, rows=total), reach, reach)
    width = len(features)
    sort = [quoted(c) for c in o.sort]
    ordered = o.df.select(BUCKET, HALO, quoted(key).cast("long").alias("__id"), *sort, *[quoted(f).cast("double").alias(f"__f{i}") for i, f in enumerate(features)])
    placed = ordered.repartition(task_partitions(df.sparkSession, o.buckets), BUCKET).sortWithinPartitions(BUCKET, *sort)
    placed = placed.select(BUCKET, HALO, "__id", *[f"__f{i}" for i in range(width)])

    def block(start: int, end: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        low, high = max(0, start - reach), min(len(x), end + reach)
        return pa.RecordBatch.from_arrays(
            [pa.array([start - low], pa.int32()), pa.array([end - start], pa.int32()), pa.array([ids[start:end].tobytes()], pa.binary()),
             pa.array([np.ascontiguousarray(x[low:high]).tobytes()], pa.binary())],
            names=["start", "own", "ids", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, x, halo, done = None, np.empty(0, np.int64), np.empty((0, width)), np.empty(0, bool), 0

        def drain(last: bool) -> Iterator[pa.RecordBatch]:
            """Emit full blocks; at the bucket's end also the rest."""
            nonlocal done
            own = np.flatnonzero(~halo)
            end_of_own = own[-1] + 1 if len(own) else 0
            begin = max(done, own[0] if len(own) else 0)
            while begin < end_of_own:
                stop = min(begin + rows, end_of_own)
                if not last and stop + reach > len(x):
                    break
                yield block(begin, stop, ids, x)
                begin = done = stop

        for batch in batches:
            bucket = batch.column(0).to_numpy()
            flags, keys, matrix = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(), batch_matrix(batch, 3, width)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else [0]
            for a, b in zip(edges, edges[1:]):
                if current is not None and bucket[a] != current:
                    yield from drain(True)
                    ids, x, halo, done = np.empty(0, np.int64), np.empty((0, width)), np.empty(0, bool), 0
                current = bucket[a]
                ids, x, halo = np.concatenate([ids, keys[a:b]]), np.concatenate([x, matrix[a:b]]), np.concatenate([halo, flags[a:b].astype(bool)])
                yield from drain(False)
                trim = max(0, done - reach)
                if trim:
                    ids, x, halo, done = ids[trim:], x[trim:], halo[trim:], done - trim
        if current is not None:
            yield from drain(True)

    return placed.mapInArrow(run, SEQUENCE_SCHEMA).repartition(task_partitions(df.sparkSession, o.buckets if total is None else math.ceil(total / rows)))


def windows_of(x: np.ndarray, length: int, first: int, stop: int) -> np.ndarray:
    """Windows that start at first..stop-1 and fit, as (count, length, width)."""
    stop = min(stop, len(x) - length + 1)
    if stop <= first:
        return np.empty((0, length, x.shape[1]))
    view = np.lib.stride_tricks.sliding_window_view(x, length, axis=0)[first:stop]
    return view.transpose(0, 2, 1)


def shapes(width: int, hidden: int) -> list[tuple[int, ...]]:
    """Input, recurrent and two bias blocks of the encoder, then of the decoder."""
    return [(width, 4 * hidden), (hidden, 4 * hidden), (4 * hidden,), (4 * hidden,),
            (hidden, 4 * width), (width, 4 * width), (4 * width,), (4 * width,)]


def start_vector(width: int, hidden: int, seed: int = 42) -> np.ndarray:
    return uniform_start(shapes(width, hidden), [hidden] * 4 + [width] * 4, seed)


def sigmoid(a: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-a)), in place."""
    np.negative(a, out=a)
    with np.errstate(over="ignore"):  # exp(-a) is infinite far below 0, where the value is 0
        np.exp(a, out=a)
    a += 1.0
    return np.reciprocal(a, out=a)


def tanh(a: np.ndarray) -> np.ndarray:
    out = sigmoid(2.0 * a)
    out *= 2.0
    out -= 1.0
    return out


def layer_forward(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states of every step and what the backward pass needs. Arrays are (steps, columns, windows): each gate of a step
    is one piece of memory."""
    steps, _, count = x.shape
    size = wh.shape[0]
    twice = np.ones(4 * size)
    twice[2 * size: 3 * size] = 2.0  # tanh(a) is 2 sigmoid(2 a) - 1, so one call serves all gates
    wx, wh, b = np.ascontiguousarray((wx * twice).T), np.ascontiguousarray((wh * twice).T), (b * twice)[:, None]
    h, c = np.zeros((size, count)), np.zeros((size, count))
    out, tape = np.empty((steps, size, count)), []
    for t in range(steps):
        gates = wh @ h
        gates += wx @ x[t]
        gates += b
        sigmoid(gates)
        i, f, g, o = (gates[k * size: (k + 1) * size] for k in range(4))
        g *= 2.0
        g -= 1.0
        before_h, before_c = h, c
        c = f * c
        c += i * g
        s = tanh(c)
        h = np.multiply(o, s, out=out[t])
        tape.append((before_h, before_c, i, f, g, o, s))
    return out, tape


def layer_backward(x: np.ndarray, tape: list, wx: np.ndarray, wh: np.ndarray, d_out: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Gradient of the inputs and of (wx, wh, b)."""
    size, count = wh.shape[0], x.shape[2]
    d_x, d_wx, d_wh, d_b = np.empty_like(x), np.zeros_like(wx), np.zeros_like(wh), np.zeros(4 * size)
    d_h, d_c, d_gates = np.zeros((size, count)), np.zeros((size, count)), np.empty((4 * size, count))
    d_i, d_f, d_g, d_o = (d_gates[k * size: (k + 1) * size] for k in range(4))
    for t in range(len(x) - 1, -1, -1):
        before_h, before_c, i, f, g, o, s = tape[t]
        d_h += d_out[t]
        d_s = d_h * o
        d_c += d_s - d_s * s * s
        np.multiply(d_c * g, i - i * i, out=d_i)
        np.multiply(d_c * before_c, f - f * f, out=d_f)
        np.multiply(d_c * i, 1.0 - g * g, out=d_g)
        np.multiply(d_h * s, o - o * o, out=d_o)
        np.matmul(wx, d_gates, out=d_x[t])
        d_wx += x[t] @ d_gates.T
        d_wh += before_h @ d_gates.T
        d_b += d_gates.sum(1)
        d_h = wh @ d_gates
        d_c *= f
    return d_x, [d_wx, d_wh, d_b]


def reconstruct(x: np.ndarray, params: list[np.ndarray]) -> tuple[np.ndarray, tuple]:
    coded, tape1 = layer_forward(x, params[0], params[1], params[2] + params[3])
    back, tape2 = layer_forward(coded, params[4], params[5], params[6] + params[7])
    return back, (coded, tape1, tape2)


def loss_and_gradient(windows: np.ndarray, vector: np.ndarray, hidden: int, cells: int) -> np.ndarray:
    """(loss, gradient...) sums of the mean squared error over ``cells`` window cells."""
    params = unpack(vector, shapes(windows.shape[2], hidden))
    total = np.zeros(len(vector) + 1)
    for at in range(0, len(windows), CHUNK):
        x = np.ascontiguousarray(windows[at: at + CHUNK].transpose(1, 2, 0))
        back, (coded, tape1, tape2) = reconstruct(x, params)
        gap = back - x
        d_coded, (d4, d5, db2) = layer_backward(coded, tape2, params[4], params[5], 2.0 * gap / cells)
        _, (d0, d1, db1) = layer_backward(x, tape1, params[0], params[1], d_coded)
        total += np.concatenate([[(gap * gap).sum() / cells], *[a.ravel() for a in (d0, d1, db1, db1, d4, d5, db2, db2)]])
    return total


def window_errors(windows: np.ndarray, vector: np.ndarray, hidden: int) -> np.ndarray:
    params = unpack(vector, shapes(windows.shape[2], hidden))
    out = []
    for at in range(0, len(windows), CHUNK):
        x = np.ascontiguousarray(windows[at: at + CHUNK].transpose(1, 2, 0))
        gap = reconstruct(x, params)[0] - x
        out.append((gap * gap).mean((0, 1)))
    return np.concatenate(out) if out else np.empty(0)


def overlap_average(errors: np.ndarray, length: int, first: int, start: int, own: int) -> np.ndarray:
    """Mean error of the windows over each own row; ``errors[0]`` starts at row ``first``."""
    sums = np.concatenate([[0.0], np.cumsum(errors)])
    rows = np.arange(start, start + own)
    low = np.clip(rows - length + 1 - first, 0, len(errors))
    high = np.clip(rows + 1 - first, 0, len(errors))
    return (sums[high] - sums[low]) / np.maximum(high - low, 1)


def block_arrays(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i in range(batch.num_rows):
        yield (batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), np.frombuffer(batch.column(2)[i].as_py(), np.int64),
               np.frombuffer(batch.column(3)[i].as_py()).reshape(-1, width))


def window_count(rows: int, length: int) -> int:
    return max(1, rows - length + 1)


def score_windows(blocks: DataFrame, width: int, length: int, errors, key: str, name: str) -> DataFrame:
    """(key, score): per-row mean of ``errors(windows)`` over the covering windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, own, ids, x in block_arrays(batch, width):
                first = max(0, start - length + 1)
                e = errors(windows_of(x, length, first, start + own))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(overlap_average(e, length, first, start, own))], names=[key, name])

    return blocks.mapInArrow(run, f"`{key}` long, `{name}` double")


def lstm_autoencoder(
    df: DataFrame, key: str, features: Sequence[str], order_by: Sequence[str], rows: int | None = None, *, seq_len: int | None = None,
    hidden_size: int = 16, lr: float = 1e-3, epochs: int = EPOCHS, name: str = "lstm", blocks: DataFrame | None = None,
    state: Adam | None = None,
) -> DataFrame:
    """(key, score): reconstruction error of the windows over each row, averaged.

    ``blocks`` may be sequence blocks already packed with a reach of at least ``seq_len - 1``, and ``state`` a training of
    these parameters to go on with, as the search leaves it.
    """
    rows = df.count() if rows is None else rows
    width = len(features)
    length = min(seq_len or min(10, max(5, rows // 10)), rows)
    blocks = blocks if blocks is not None else keep(pack_sequences(df, key, features, order_by, length - 1, total=rows))
    partitions = blocks.rdd.getNumPartitions()
    cells = window_count(rows, length) * length * width

    def gradient(vector: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            total = np.zeros(len(vector) + 1)
            for batch in batches:
                for start, own, _, x in block_arrays(batch, width):
                    total += loss_and_gradient(windows_of(x, length, start, start + own), vector, hidden_size, cells)
            return total

        total = block_sums(blocks, run, len(vector) + 1, partitions)
        return float(total[0]), total[1:]

    vector, _ = adam(start_vector(width, hidden_size), gradient, epochs, lr, state)
    return score_windows(blocks, width, length, lambda w: window_errors(w, vector, hidden_size), key, name)


def sequence_windows(df: DataFrame, key: str, features: Sequence[str], order_by: Sequence[str], length: int, **kw) -> DataFrame:
    """(key, window): every full window as a flat array, named by its first row."""
    width = len(features)
    length = min(length, df.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, own, ids, x in block_arrays(batch, width):
                w = windows_of(x, length, start, start + own)
                flat = np.ascontiguousarray(w).reshape(len(w), -1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[: len(w)]), pa.array(list(flat), pa.list_(pa.float64()))], names=[key, "window"])

    return pack_sequences(df, key, features, order_by, length - 1, **kw).mapInArrow(run, f"`{key}` long, window array<double>")


def window_means(df: DataFrame, key: str, features: Sequence[str], order_by: Sequence[str], length: int, **kw) -> DataFrame:
    """(key, overlap_mean): window means averaged over the windows covering each row."""
    length = min(length, df.count())
    blocks = pack_sequences(df, key, features, order_by, length - 1, **kw)
    return score_windows(blocks, len(features), length, lambda w: w.mean((1, 2)) if len(w) else np.empty(0), key, "overlap_mean")
