"""Rows packed into matrix blocks, sums over blocks, and batch scoring."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddrows.functions.schema import quoted

BLOCK_ROWS = 4096
DIRECT_PARTS = 256
FAN_IN = 64  # vectors that one task adds
SMALL_BLOCKS = 16  # blocks per core up to which a table is dealt out
SPREAD_ROWS = 2048


def matrix_column(x: np.ndarray) -> pa.Array:
    """One binary value per matrix row."""
    x = np.ascontiguousarray(x, dtype=np.float64)
    width = x.shape[1] * 8
    offsets = np.arange(0, (len(x) + 1) * width, max(width, 1), dtype=np.int32)[: len(x) + 1]
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x.tobytes())])


def column_matrix(column: pa.Array, width: int) -> np.ndarray:
    """Matrix with one row per binary value."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, width)


def batch_matrix(batch: pa.RecordBatch, start: int, width: int) -> np.ndarray:
    return np.column_stack([batch.column(start + i).to_numpy(zero_copy_only=False) for i in range(width)]).astype(np.float64)


def spread(df: DataFrame, rows: int | None) -> DataFrame:
    """A table dealt out evenly for heavy batch work.

    A scan does not fill the cluster, whatever the table's size: a file's row groups are not divided, so a few tasks may hold
    all rows. Moving the rows once costs little beside passes that take microseconds a row.
    """
    if rows is None:
        return df
    parallelism = df.sparkSession.sparkContext.defaultParallelism
    if rows > SMALL_BLOCKS * BLOCK_ROWS * parallelism:
        return df.repartition(task_partitions(df.sparkSession, rows))
    return df.repartition(max(1, min(parallelism, math.ceil(rows / SPREAD_ROWS))))


def task_partitions(spark, groups: int) -> int:
    """Partitions for ``groups`` compute-heavy groups; a fixed number is not merged by size at run time."""
    return max(1, min(groups, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)))


def pack_rows(df: DataFrame, features: Sequence[str], rows: int = BLOCK_ROWS, total: int | None = None) -> DataFrame:
    """(n, x): row-major float64 blocks, so later passes read matrices instead of rows."""
    width = len(features)
    df = spread(df.select(*[quoted(f) for f in features]), total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch_matrix(batch, 0, width)
            for at in range(0, len(x), rows):
                part = x[at: at + rows]
                yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["n", "x"])

    return df.select(*[quoted(f).cast("double").alias(f"c{i}") for i, f in enumerate(features)]).mapInArrow(run, "n int, x binary")


def score_rows(
    df: DataFrame, passed: Sequence[str], features: Sequence[str], scorers: Mapping[str, Callable[[np.ndarray], np.ndarray]],
    rows: int | None = None,
) -> DataFrame:
    """Passed columns plus one column per scorer; all scorers share one pass over the rows."""
    fields = {f.name: f for f in df.schema.fields}
    schema = T.StructType([fields[c] for c in passed] + [T.StructField(n, T.DoubleType()) for n in scorers])
    width = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch_matrix(batch, len(passed), width)
                scores = [pa.array(np.asarray(s(x), dtype=np.float64)) for s in scorers.values()]
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(passed))] + scores, names=schema.names)

    picked = df.select(*[quoted(c) for c in passed], *[quoted(f).cast("double").alias(f"__f{i}") for i, f in enumerate(features)])
    return spread(picked, rows).mapInArrow(run, schema)


def block_sums(
    blocks: DataFrame, measure: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int, partitions: int,
    combine: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add,
) -> np.ndarray:
    """Sum of a fixed-size vector over all partitions.

    ``measure`` turns a partition into one vector. While there are many, FAN_IN of them at a time are added on the
    executors, level by level, so no task holds more than FAN_IN and at most DIRECT_PARTS reach the driver. They are
    added in partition order: the result is repeatable. ``combine`` may replace the addition; without any partition the
    result is zero.
    """

    def folded(vectors: list[bytes]) -> np.ndarray:
        total = np.frombuffer(vectors[0]).copy() if vectors else np.zeros(size)
        for v in vectors[1:]:
            total = combine(total, np.frombuffer(v))
        return total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = measure(batches)
        pid = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["pid", "v"])

    parts = blocks.mapInArrow(run, "pid int, v binary")

    def add(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("pid").to_pylist(), table.column("v").to_pylist()))
        total = folded([v for _, v in rows])
        return pa.table({"pid": pa.array([rows[0][0] // FAN_IN], pa.int32()), "v": pa.array([total.tobytes()], pa.binary())})

    while partitions > DIRECT_PARTS:
        parts = parts.groupBy(F.floor(F.col("pid") / FAN_IN)).applyInArrow(add, "pid int, v binary")
        partitions = math.ceil(partitions / FAN_IN)
    return folded([bytes(row["v"]) for row in sorted(parts.collect(), key=lambda r: r["pid"])])
