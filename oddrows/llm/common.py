"""Small helpers the corpus operators share."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddrows.session import materialize, scratch_dir

__all__ = ["append", "lookup", "materialize", "parallelism", "per_batch", "scratch_dir", "scratch_path", "table", "text_of"]

#: A key is hot when it holds at least this share of the rows; so at most 1 / HOT_SHARE keys are.
HOT_SHARE = 1e-3
#: Rows that numpy code handles at once inside a task.
SLICE_ROWS = 256
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new name in the shared folder."""
    return f"{scratch_dir(spark)}/oddrows-{tag}-{uuid.uuid4().hex}"


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_of(column: str = "text") -> Column:
    """The text, a null being the empty text."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def per_batch(run: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], rows: int = SLICE_ROWS, bytes_at_once: int = SLICE_BYTES):
    """For mapInArrow: ``run`` sees zero-copy slices of bounded rows and, above one row, of bounded bytes."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, rows)
                while part.num_rows > 1 and part.get_total_buffer_size() and part.nbytes > bytes_at_once:
                    part = batch.slice(at, max(1, min(part.num_rows // 2, math.ceil(part.num_rows * bytes_at_once / part.nbytes))))
                at += part.num_rows
                yield from run(part)
        pa.default_memory_pool().release_unused()  # a task's process is used again

    return stream


def lookup(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, how: str = "left", wide: bool = False) -> DataFrame:
    """``left`` joined to ``right`` (one row a key; ``weight``: how many left rows have the key) whatever the skew.

    Keys with at least ``HOT_SHARE`` of the ``total`` left rows are at most ``1 / HOT_SHARE``, so their rows are
    broadcast; left rows that meet one there never enter the shuffled join under that key.
    ``wide``: rows are costly to move, so those already met take no part in the shuffle, at the price of computing
    ``left`` twice. Key columns must not be null.
    """
    cut = max(1.0, total * HOT_SHARE)
    values = [c for c in right.columns if c not in keys]
    hot = right.where(F.col(weight) >= cut).select(*keys, F.struct(*values).alias("__hot"))
    cold = right.where(F.col(weight) < cut).select(*[F.col(k).alias(f"__r_{k}") for k in keys], F.struct(*values).alias("__cold"))
    met = left.join(F.broadcast(hot), keys, "left")
    same = [F.col(f"__l_{k}") == F.col(f"__r_{k}") for k in keys]
    if wide:
        rest = met.where(F.col("__hot").isNull()).withColumns({f"__l_{k}": F.col(k) for k in keys}).join(cold, same, how)
        rest = rest.select(*[F.col(f"`{c}`") for c in left.columns], F.col("__cold").alias("__any"))
        out = met.where(F.col("__hot").isNotNull()).select(*[F.col(f"`{c}`") for c in left.columns], F.col("__hot").alias("__any")).unionByName(rest)
    else:
        # Met rows carry no key but a salt of their own, so that they are dealt evenly.
        salt = F.when(F.col("__hot").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(4096))).cast("int")
        salted = met.withColumns({f"__l_{k}": F.when(F.col("__hot").isNull(), F.col(k)) for k in keys} | {"__salt": salt})
        # (The right side's salt is always 0, but no constant: else Spark would drop it from the join's keys.)
        zero = F.pmod(F.xxhash64(*[F.col(f"__r_{k}") for k in keys]), F.lit(1)).cast("int")
        out = salted.join(cold.withColumn("__r_salt", zero), [*same, F.col("__salt") == F.col("__r_salt")], "left").withColumn("__any", F.coalesce("__hot", "__cold"))
        if how == "inner":
            out = out.where(F.col("__any").isNotNull())
    return out.select(*[F.col(f"`{c}`") for c in left.columns], *[F.col(f"__any.`{v}`").alias(v) for v in values])


def append(df: DataFrame, inputs: list[Column | str], start: Callable[[], Callable], fields: list[tuple[str, str]], drop: Sequence[str] = ()) -> DataFrame:
    """``df`` with columns made by Python in Arrow batches; ``fields``: names and Spark types, replacing equal names.

    Columns of ``drop`` may be inputs but are not in the result, and an input given by name is a column that stays: so wide
    columns are sent to a task once, and back only where they are wanted.

    ``start()`` runs once a task and gives a function from the inputs' Arrow arrays to the new arrays.
    """
    names = {*drop, *(n for n, _ in fields)}
    kept = [c for c in df.columns if c not in names]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], *[c.alias(f"__in{i}") for i, c in enumerate(inputs) if not isinstance(c, str)])
    schema = T.StructType([f for f in df.schema.fields if f.name not in names] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])
    out_names, n_kept = [*kept, *[n for n, _ in fields]], len(kept)
    places = [rows.columns.index(c if isinstance(c, str) else f"__in{i}") for i, c in enumerate(inputs)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            made = make(*[batch.column(p) for p in places])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], *made], names=out_names)

        yield from per_batch(run)(batches)

    return rows.mapInArrow(task, schema)
