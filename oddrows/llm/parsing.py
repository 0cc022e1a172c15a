"""Document fingerprints by locally consistent parsing.

A text is parsed bottom up from its UTF-8 bytes. On each level, runs of one name become one name; deterministic coin
tossing then gives every name a label below 8 that depends on a few neighbours to its left only (twice the lowest bit in
which it differs from its left neighbour, plus that bit, repeated); local maxima of the labels begin phrases; and a phrase
gets a name from the names in it. Phrases are about three names long and never much longer, and where two texts share
a substring, their phrases inside it are the same whatever the offsets.

The fingerprint is the sorted list of the ``SKETCH`` smallest 32-bit hashes of the phrase names of levels ``LEVELS``, in
hex; likeness is the Jaccard estimate of two such lists (exact below ``SKETCH`` names).

Defined cases: null and empty texts have the empty fingerprint; two empty fingerprints are alike (1), one is not (0); rows
are neighbours by descending id, ties by the hash of their text, null ids last; repeated rows are rows of their own; an
empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddrows.llm.common import append, parallelism, text_of

SKETCH = 64
LEVELS = (2, 3, 4)
CHUNK_BYTES = 1 << 20
MIN_ID = -(1 << 63)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_RADIX = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MUL
    return x ^ (x >> np.uint64(29))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _RADIX)


def _toss(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round: twice the lowest bit that differs from the left neighbour, plus that bit's value. ``first``: no neighbour."""
    left = np.empty_like(label)
    left[1:] = label[:-1]
    left[first] = ~label[first]
    differs = label ^ left
    low = differs & (~differs + label.dtype.type(1))
    bit = np.bitwise_count(low - label.dtype.type(1))
    return (2 * bit + ((label & low) != 0)).astype(np.uint8)


def next_level(names: np.ndarray, firsts: np.ndarray, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names of the next level and the places of each text's first phrase. No text here is empty."""
    first = np.zeros(len(names), bool)
    first[firsts] = True
    # Runs of one name become one name. Neighbours then differ, in their labels too.
    head = first.copy()
    head[1:] |= names[1:] != names[:-1]
    if not head.all():
        at = np.flatnonzero(head)
        length = np.diff(np.append(at, len(names))).astype(np.uint64)
        names, first = names[at], first[at]
        label = None if label is None else label[at]
        long = length > 1
        names = names.copy()
        names[long] = _mix(names[long] + length[long] * _RADIX)
    firsts = np.flatnonzero(first)
    tossed = names if label is None else label
    for _ in range(4 if tossed.dtype == np.uint64 else 3):
        tossed = _toss(tossed, firsts)
    rises = np.empty(len(names), bool)
    rises[0], rises[1:] = True, tossed[1:] > tossed[:-1]
    begins = np.empty(len(names), bool)
    begins[-1], begins[:-1] = False, ~rises[1:]
    begins &= rises
    begins[1:] &= ~first[:-1]  # a text's second name stays with its first
    begins[np.append(firsts[1:], len(names)) - 1] = False  # nor does what follows a text touch its parse
    begins[firsts] = True
    starts = np.flatnonzero(begins)
    size = np.diff(np.append(starts, len(names)))
    place = np.arange(len(names)) - np.repeat(starts, size)
    powers = np.cumprod(np.full(int(size.max()) + 1, _RADIX))
    phrase = np.add.reduceat(_mix(names) * powers[place], starts)
    return _mix(phrase + size.astype(np.uint64)), np.flatnonzero(first[starts])


def sketches(texts: list[bytes], k: int = SKETCH, levels: tuple[int, ...] = LEVELS) -> list[np.ndarray]:
    """The k smallest phrase hashes (uint32, sorted) of each text."""
    full = [i for i, t in enumerate(texts) if t]
    out = [np.zeros(0, np.uint32)] * len(texts)
    if not full:
        return out
    raw = np.frombuffer(b"".join(texts[i] for i in full), np.uint8)
    firsts = np.concatenate([[0], np.cumsum([len(texts[i]) for i in full])[:-1]]).astype(np.int64)
    names, label, keys = _BYTES[raw], raw, []
    for level in range(1, max(levels) + 1):
        names, firsts = next_level(names, firsts, label)
        label = None
        if level in levels:
            owner = np.repeat(np.arange(len(full), dtype=np.uint64), np.diff(np.append(firsts, len(names))))
            keys.append((owner << np.uint64(32)) | (_mix(names + np.uint64(level)) >> np.uint64(32)))
    keys = np.sort(np.concatenate(keys))  # (faster than np.unique, which hashes)
    keys = keys[np.append(True, keys[1:] != keys[:-1])]
    owner = (keys >> np.uint64(32)).astype(np.int64)
    edges = np.searchsorted(owner, np.arange(len(full) + 1))
    low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    for j, i in enumerate(full):
        out[i] = low[edges[j] : min(edges[j + 1], edges[j] + k)]
    return out


def to_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray, k: int = SKETCH) -> float:
    """Jaccard estimate from the k smallest hashes of the union."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    new = np.append(True, both[1:] != both[:-1])
    twice = np.append(both[1:] == both[:-1], False)
    union = np.flatnonzero(new)[:k]
    return float(twice[union].sum() / len(union))


def fingerprints(docs: DataFrame, text_col: str = "text", k: int = SKETCH, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """``docs`` with their fingerprint; one pass, no shuffle."""
    def start():
        return lambda texts: [pa.array([to_text(s) for s in sketches([t.as_py().encode() for t in texts], k, levels)], pa.string())]

    return append(docs, [text_of(text_col)], start, [("fingerprint", "string")])


def _descending(rows: DataFrame) -> DataFrame:
    """``rows`` (id, text) cut into ranges of ids, each range sorted by descending id in one partition and followed by the
    first row of the next range (halo). Ranges are cut by quantiles, so a row's range depends on its id alone."""
    spark = rows.sparkSession
    wanted = parallelism(spark)
    shares = [i / wanted for i in range(1, wanted)]
    cuts = rows.agg(F.percentile_approx(F.col("id"), F.array(*[F.lit(s) for s in shares]), 100 * wanted)).first()[0] if shares else None
    splits = [float("-inf"), *sorted({float(c) for c in cuts or []}), float("inf")]
    if len(splits) > 2:
        ranged = Bucketizer(inputCol="__id", outputCol="__range", splits=splits).transform(rows.withColumn("__id", F.col("id").cast("double"))).drop("__id")
        ranged = ranged.withColumn("__range", F.col("__range").cast("int"))
    else:
        ranged = rows.withColumn("__range", F.lit(0))
    # One row a range: its largest id, which the next higher range (or, around the end, the lowest) must see.
    tops = sorted((r[0], r[1]) for r in ranged.groupBy("__range").agg(F.max("id")).collect())
    if not tops:
        return ranged.withColumns({"halo": F.lit(False)})
    to = {top: tops[(i + 1) % len(tops)][0] for i, (_, top) in enumerate(tops)}
    sent = F.broadcast(spark.createDataFrame(list(to.items()), "id long, __to int"))
    halo = ranged.join(sent, "id").select("id", "text", F.col("__to").alias("__range"), F.lit(True).alias("halo"))
    both = ranged.withColumn("halo", F.lit(False)).unionByName(halo)
    n = len(splits) - 1
    return both.repartitionById(n, F.col("__range")).sortWithinPartitions("__range", "halo", F.desc("id"), F.xxhash64("text"))


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SKETCH, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Fingerprints of each text and of its edit: its second half replaced by the start of the next document's text."""
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(MIN_ID)).alias("id"), text_of(text_col).alias("text"))
    ordered = _descending(rows).select("id", "text", "__range", "halo")
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ])

    def made(held: list[tuple[int, str, str]]) -> pa.RecordBatch:
        """held: id, text, next text."""
        edited = [(t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode() for _, t, after in held]
        found = sketches([*[t.encode() for _, t, _ in held], held[-1][2].encode(), *edited], k, levels)
        n, out = len(held), []
        for i, (doc_id, text, after) in enumerate(held):
            own, changed, following = found[i], found[n + 1 + i], found[i + 1]
            out.append((
                None if doc_id == MIN_ID else doc_id, len(text), hashlib.sha256(edited[i]).hexdigest(), to_text(own), to_text(changed),
                likeness(own, changed, k), likeness(own, following, k),
            ))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last, where, closed = [], 0, None, None, True
        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, text, at, halo = (batch.column(c)[i].as_py() for c in range(4))
                if at != where:
                    last, where, closed = None, at, False
                if closed:
                    continue  # more halo rows of the same id
                if last is not None:
                    held.append((*last, text))
                    size += len(last[1])
                last, closed = (doc_id, text), halo
                # A chunk ends where its last next text belongs to the same range.
                if held and (size > CHUNK_BYTES or closed):
                    yield made(held)
                    held, size = [], 0
        assert not held

    return ordered.mapInArrow(task, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
