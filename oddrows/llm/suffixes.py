"""Removing byte strings that occur more than once, by hash-compared suffix sorting.

Every byte of a ``width``-byte string that also starts elsewhere (in any text, itself included) is removed. Strings are
compared on the input; overlaps count.

1. **Anchors.** In each window of ``width`` bytes the ``GRAM``-byte strings with the smallest mixed polynomial hash are
   anchors. Equal windows have anchors at equal places, so a repeated window always holds an anchor whose hash occurs
   again. Anchors are counted in Spark; those that occur once are dropped, and with them nearly all of the corpus.
2. **Suffixes.** What is left around an anchor (the bytes of all windows that have it as an anchor) is its context. Equal
   contexts are combined before the shuffle. The suffixes of all contexts of an anchor are sorted bucket by bucket (a bucket:
   same anchor, same distance to it) by a merge sort. A comparison finds the common extension of two suffixes by binary
   search on prefix polynomial hashes, so it takes logarithmically many steps. Neighbours that agree in ``width`` bytes
   are repeats; their bytes are compared to rule out collisions of the hash.
3. **Spans.** Repeated suffixes of a context are carried to all its places and united by text.

An anchor with more than ``MAX_CONTEXTS`` different contexts would not fit one task. Its suffixes are told apart by
digests of their ``width`` bytes instead, aggregated in Spark: the same result at any size.

Defined cases: null text is empty; texts shorter than ``width`` stay whole; rows that repeat a document are occurrences of
their own, so repeated long texts vanish altogether; an empty table gives no row; extra columns are carried along by
``remove``, where what is left of a text is read as UTF-8 without the parts of cut characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddrows.llm.common import append, lookup, materialize, per_batch, text_of

WIDTH = 200
GRAM = 64
MAX_CONTEXTS = 4096
#: Bytes of a text that are hashed at once, and contexts that are sorted at once.
BLOCK_BYTES = 1 << 20
BLOCK_CONTEXTS = 512
#: Bits of the map that tells texts without repeats before they are shuffled: a fixed size, 2 MB.
MAP_BITS = 1 << 24
_MUL = np.uint64(0x9E3779B97F4A7C15)
_RADIX = 0xD6E8FEB86659FD93
_INVERSE = pow(_RADIX, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MUL
    return x ^ (x >> np.uint64(29))


_VALUES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_RADIX))


def _powers(radix: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(radix))
    out[:1] = 1
    return np.cumprod(out)


def _sliding(x: np.ndarray, width: int, reduce: np.ufunc, pad: int) -> np.ndarray:
    """reduce over every run of ``width`` values: two passes, whatever the width."""
    n = len(x) - width + 1
    full = np.full(-(-len(x) // width) * width, np.uint64(pad))
    full[: len(x)] = x
    grid = full.reshape(-1, width)
    ahead = reduce.accumulate(grid, axis=1).ravel()
    behind = reduce.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return reduce(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors_in(data: np.ndarray, ends: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> np.ndarray:
    """Anchors of joined texts that end at ``ends``, as rows: place, hash (as signed), first and last start of the windows
    that have it as an anchor. Those windows are neighbours, since all that lies between two of them is no smaller."""
    n = len(data) - width + 1
    if n < 1:
        return np.zeros((4, 0), np.int64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * _powers(_INVERSE, len(data)), out=sums[1:])
    grams = _mix((sums[gram:] - sums[:-gram]) * _powers(_RADIX, len(data) - gram + 1)) | np.uint64(1)
    span = width - gram + 1
    least = _sliding(grams, span, np.minimum, 2**64 - 1)
    # A window that reaches into the next text is none.
    inside = np.ones(n, bool)
    for e in ends[:-1].tolist():
        inside[max(0, e - width + 1) : min(n, e)] = False
    least[~inside] = 0
    padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    at = np.flatnonzero(_sliding(padded, span, np.maximum, 0) == grams)
    # Runs of windows with one smallest hash; an anchor's run is the last of its hash that begins at or before it.
    begins = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    ends_ = np.append(begins[1:], n) - 1
    values, number = np.unique(least[begins], return_inverse=True)
    key = number * (len(data) + 1) + begins
    order = np.argsort(key)
    wanted = np.searchsorted(values, grams[at]) * (len(data) + 1) + at
    run = order[np.searchsorted(key[order], wanted, side="right") - 1]
    return np.stack([at, grams[at].view(np.int64), np.maximum(begins[run], at - span + 1), np.minimum(ends_[run], at)])


def text_anchors(texts: list[bytes], width: int = WIDTH, gram: int = GRAM) -> list[np.ndarray]:
    """The anchors of each text; long texts in blocks that overlap by a window."""
    out = [np.zeros((4, 0), np.int64) for _ in texts]
    short = [i for i, t in enumerate(texts) if width <= len(t) <= BLOCK_BYTES]
    if short:
        ends = np.cumsum([len(texts[i]) for i in short])
        found = anchors_in(np.frombuffer(b"".join(texts[i] for i in short), np.uint8), ends, width, gram)
        cuts = np.searchsorted(found[0], ends)
        for j, i in enumerate(short):
            part = found[:, cuts[j - 1] if j else 0 : cuts[j]].copy()
            part[[0, 2, 3]] -= ends[j] - len(texts[i])
            out[i] = part
    for i, t in enumerate(texts):
        if len(t) > BLOCK_BYTES:
            data, merged = np.frombuffer(t, np.uint8), {}
            for a in range(0, len(t) - width + 1, BLOCK_BYTES):
                block = data[a : a + BLOCK_BYTES + width - 1]
                for place, h, first, last in zip(*(anchors_in(block, np.array([len(block)]), width, gram).tolist())):
                    was = merged.get(place + a, (h, first + a, last + a))
                    merged[place + a] = (h, min(was[1], first + a), max(was[2], last + a))
            out[i] = np.array([(p, *merged[p]) for p in sorted(merged)], np.int64).reshape(-1, 4).T
    return out


def _packed(found: np.ndarray, width: int) -> list[int]:
    """Place, reach to the left and reach to the right of each anchor's context in one number."""
    place, _, first, last = found
    return ((place << 24) | ((place - first) << 12) | (last + width - place)).tolist()


class Contexts:
    """Contexts of some anchors, aligned at the anchor, with prefix hashes."""

    def __init__(self, contexts: list[bytes], lefts: list[int], groups: list[int], width: int = WIDTH, gram: int = GRAM) -> None:
        self.width, self.columns = width, width - gram + 1
        left = self.columns - 1
        self.bytes = np.zeros((len(contexts), left + width), np.uint8)
        self.first = left - np.array(lefts)
        self.last = self.first + np.array([len(c) for c in contexts]) - width  # last start of a whole window
        for row, (c, a) in enumerate(zip(contexts, self.first.tolist())):
            self.bytes[row, a : a + len(c)] = np.frombuffer(c, np.uint8)
        self.groups = np.array(groups)
        sums = np.zeros((len(contexts), left + width + 1), np.uint64)
        np.cumsum(_VALUES[self.bytes] * _powers(_INVERSE, left + width), axis=1, out=sums[:, 1:])
        self.stride, self.sums = left + width + 1, sums.ravel()

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of every suffix whose first ``width`` bytes another context of its group has at that column."""
        size = self.last - self.first + 1
        row = np.repeat(np.arange(len(self.bytes)), size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + self.first[row]
        bucket = self.groups[row] * self.columns + at
        order = np.argsort(bucket, kind="stable")
        shared = np.bincount(bucket, minlength=1)[bucket[order]] > 1
        order = order[shared]
        row, at, bucket = row[order], at[order], bucket[order]
        if not len(row):
            return row, at
        # Suffixes of one bucket begin in the same column, so prefix sums are compared without a factor.
        self.start = row * self.stride + at
        self.whole = self.sums[self.start + self.width] - self.sums[self.start]
        head = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        size = np.diff(np.append(head, len(row)))
        item = self._sorted(np.repeat(head, size), np.repeat(size, size))
        pair = np.flatnonzero((bucket[1:] == bucket[:-1]) & (self.whole[item[1:]] == self.whole[item[:-1]]))
        true = self._verified(row[item[pair]], row[item[pair + 1]], at[pair])
        hit = np.zeros(len(row), bool)
        hit[item[pair[true]]] = hit[item[pair[true] + 1]] = True
        for b in np.unique(bucket[pair[~true]]).tolist():  # a hash collision: that bucket is decided by its bytes
            seen: dict[bytes, list[int]] = {}
            for i in np.flatnonzero(bucket == b).tolist():
                hit[i] = False
                seen.setdefault(self.bytes[row[i], at[i] : at[i] + self.width].tobytes(), []).append(i)
            for same in seen.values():
                hit[same] = len(same) > 1
        return row[hit], at[hit]

    def less(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(suffix i < suffix j, they agree in a whole window): the end of their common extension is found by binary
        search on the prefix hashes, and the bytes after it decide."""
        equal = self.whole[i] == self.whole[j]
        less = np.zeros(len(i), bool)
        todo = np.flatnonzero(~equal)
        if len(todo):
            x, y = self.start[i[todo]], self.start[j[todo]]
            apart = self.sums[x] - self.sums[y]
            low, high = np.zeros(len(todo), np.int64), np.full(len(todo), self.width - 1)
            for _ in range(int(self.width).bit_length()):
                middle = (low + high + 1) >> 1
                longer = self.sums[x + middle] - self.sums[y + middle] == apart
                low, high = np.where(longer, middle, low), np.where(longer, high, np.maximum(low, middle - 1))
            data = self.bytes.ravel()  # a row of bytes is one shorter than its sums
            less[todo] = data[x - x // self.stride + low] < data[y - y // self.stride + low]
        return less, equal

    def _sorted(self, base: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Items in the order of their suffixes within each bucket: a merge sort of all buckets at once.

        In a merge an item's place is its own in its run plus how many of the other run go before it.
        """
        item, width = np.arange(len(base)), 1
        own = item - base
        while width < size.max(initial=0):
            run = own // width
            low = np.minimum((run ^ 1) * width, size)
            high = np.minimum(low + width, size)
            act = np.flatnonzero(low < high)
            lo, hi, from_, right = low[act], high[act], base[act], (run[act] & 1).astype(bool)
            start = lo.copy()
            k = np.arange(len(act))
            while len(k):
                middle = (lo[k] + hi[k]) >> 1
                less, equal = self.less(item[from_[k] + middle], item[act[k]])
                before = less | (equal & right[k])
                lo[k] = np.where(before, middle + 1, lo[k])
                hi[k] = np.where(before, hi[k], middle)
                k = k[lo[k] < hi[k]]
            place = np.arange(len(item))
            place[act] = from_ + (run[act] >> 1) * 2 * width + (own[act] - run[act] * width) + (lo - start)
            moved = np.empty_like(item)
            moved[place] = item
            item, width = moved, width * 2
        return item

    def _verified(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Byte comparison: each pair of contexts once, whatever the number of its suffixes."""
        pairs, which = np.unique(a * len(self.bytes) + b, return_inverse=True)
        x, y = np.divmod(pairs, len(self.bytes))
        differ = np.zeros((len(x), self.bytes.shape[1] + 1), np.int32)
        np.cumsum(self.bytes[x] != self.bytes[y], axis=1, out=differ[:, 1:])
        return differ[which, at + self.width] == differ[which, at]


def _runs(columns: np.ndarray, origin: int, width: int) -> list[int]:
    """Covered bytes relative to the anchor, as from, to, from, to, ..., of windows at sorted ``columns``."""
    cut = np.flatnonzero(np.diff(columns) > width) + 1
    firsts, lasts = columns[np.append(0, cut)], columns[np.append(cut - 1, -1)]
    return np.stack([firsts - origin, lasts - origin + width], axis=1).ravel().tolist()


def _keys(id_col: str, text_col: str) -> list[Column]:
    """A row's identity: its id, and a hash that tells rows with the same or no id apart by text."""
    c = F.col(f"`{id_col}`").cast("long")
    return [F.coalesce(c, F.lit(0)).alias("__did"), F.xxhash64(c.isNull(), text_of(text_col)).alias("__dh")]


def _suspect(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with ``__maybe``: false where no row of ``found`` has the keys. The map of key hashes has a fixed size, so it is
    broadcast; if it fills up, more rows are suspected than need be and nothing else changes."""
    bit = F.pmod(F.xxhash64("__did", "__dh"), F.lit(MAP_BITS)) + 1
    maps = found.select(F.bitmap_bucket_number(bit).alias("__bucket"), F.bitmap_bit_position(bit).alias("at")).groupBy("__bucket").agg(F.bitmap_construct_agg("at").alias("__map"))
    byte = F.conv(F.hex(F.substring(F.col("__map"), (F.col("__at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.floor(byte / F.pow(F.lit(2), F.col("__at") % 8)) % 2 == 1
    placed = rows.withColumns({"__bucket": F.bitmap_bucket_number(bit), "__at": F.bitmap_bit_position(bit)}).join(F.broadcast(maps), "__bucket", "left")
    return placed.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce(hit, F.lit(False)).alias("__maybe"))


def _context(text: bytes, packed: int) -> tuple[bytes, int, bytes]:
    """The bytes of all windows that have the anchor, how many lie before it, and a digest."""
    at, left, right = packed >> 24, (packed >> 12) & 4095, packed & 4095
    context = text[at - left : at + right]
    return context, left, xxhash.xxh3_128_digest(context, seed=left)


def _contexts(around: DataFrame) -> DataFrame:
    """Different contexts of each anchor with their number of places, combined in the task first."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], list] = {}

        def flush() -> pa.RecordBatch:
            rows = [(a, h, c, left, n) for (a, h), (c, left, n) in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64()))], names=["anchor", "digest", "context", "left", "n"])

        for batch in batches:
            for text, places, hashes in zip(*batch.columns):
                text = text.as_py()
                for at, anchor in zip(places.as_py(), hashes.as_py()):
                    context, left, digest = _context(text, at)
                    slot = held.setdefault((anchor, digest), [context, left, 0])
                    slot[2] += 1
                if len(held) > 20_000:
                    yield flush()
        if held:
            yield flush()

    return around.select("data", "places", "hashes").mapInArrow(task, "anchor long, digest binary, context binary, left int, n long")


def _sort_task(width: int, gram: int):
    """Over contexts sorted by anchor and digest: the repeated parts of each."""
    names, origin = ["anchor", "digest", "n", "ranges"], width - gram

    def settle(held: list[list]) -> pa.RecordBatch | None:
        """held: anchor, digest, context, left, n of whole anchors."""
        rows, several = [], []
        for i, x in enumerate(held):
            alone = (not i or held[i - 1][0] != x[0]) and (i + 1 == len(held) or held[i + 1][0] != x[0])
            if not alone:
                several.append(x)
            if x[4] > 1:  # what occurs at two places with its whole context is repeated all over
                rows.append((x[0], x[1], x[4], [-x[3], len(x[2]) - x[3]]))
        for begin, end in _blocks([x[0] for x in several]):
            part, number = several[begin:end], {}
            groups = [number.setdefault(x[0], len(number)) for x in part]
            c = Contexts([x[2] for x in part], [x[3] for x in part], groups, width, gram)
            row, at = c.repeated()
            order = np.lexsort((at, row))
            row, at = row[order], at[order]
            edges = np.searchsorted(row, np.arange(len(part) + 1))
            rows += [(x[0], x[1], x[4], _runs(at[a:e], origin, width)) for x, a, e in zip(part, edges[:-1], edges[1:]) if x[4] == 1 and a < e]
        if not rows:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int32())))], names=names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        for batch in batches:
            for anchor, digest, context, left, n in zip(*[c.to_pylist() for c in batch.columns]):
                if held and held[-1][0] == anchor and held[-1][1] == digest:
                    held[-1][4] += n
                    continue
                if len(held) >= BLOCK_CONTEXTS and held[-1][0] != anchor:
                    out, held = settle(held), []
                    if out is not None:
                        yield out
                held.append([anchor, digest, context, left, n])
        if held and (out := settle(held)) is not None:
            yield out

    return task


def _blocks(anchors: list[int]) -> list[tuple[int, int]]:
    """Cuts between anchors so that a block has about BLOCK_CONTEXTS contexts, or one anchor."""
    out, begin = [], 0
    for i in range(1, len(anchors) + 1):
        if i == len(anchors) or (i - begin >= BLOCK_CONTEXTS and anchors[i] != anchors[i - 1]):
            out.append((begin, i))
            begin = i
    return out


def _crowded(contexts: DataFrame, width: int, gram: int) -> DataFrame:
    """The same as ``_sort_task`` for anchors with too many contexts for a task: suffixes told apart by digests."""
    origin = width - gram

    def windows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for anchor, digest, context, left, n in zip(*[c.to_pylist() for c in batch.columns]):
            first = origin - left
            rows += [(anchor, digest, n, first + i, hashlib.blake2b(context[i : i + width], digest_size=16).digest()) for i in range(len(context) - width + 1)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()))], names=["anchor", "digest", "n", "at", "window"])

    one = contexts.groupBy("anchor", "digest").agg(F.min(F.struct("context", "left")).alias("c"), F.sum("n").alias("n")).select("anchor", "digest", "c.context", "c.left", "n")
    seen = one.mapInArrow(per_batch(windows, 64), "anchor long, digest binary, n long, at int, window binary")
    twice = seen.groupBy("anchor", "at", "window").agg(F.sum("n").alias("all")).where("all > 1").drop("all")
    hit = seen.join(twice, ["anchor", "at", "window"]).groupBy("anchor", "digest").agg(F.max("n").alias("n"), F.array_sort(F.collect_list("at")).alias("at"))
    # Each column covers from its place to a width further; spans are united later.
    return hit.select("anchor", "digest", "n", F.flatten(F.transform("at", lambda s: F.array(s - origin, s - origin + width))).alias("ranges"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, max_contexts: int = MAX_CONTEXTS) -> tuple[DataFrame, DataFrame]:
    """(every row: row, __did, __dh, doc_id, n_bytes, sha256; changed rows: row, __did, __dh, n_removed, n_spans, kept)."""
    keys = _keys(id_col, text_col)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *keys, text_of(text_col).cast("binary").alias("data"))

    def start():
        def make(data: pa.Array) -> list[pa.Array]:
            found = text_anchors(data.to_pylist(), width, gram)
            return [pa.array([_packed(x, width) for x in found], pa.list_(pa.int64())), pa.array([x[1].tolist() for x in found], pa.list_(pa.int64()))]

        return make

    found = append(rows.withColumns({"n_bytes": F.octet_length("data").cast("long"), "sha256": F.sha2("data", 256)}), [F.col("data")], start, [("places", "array<long>"), ("hashes", "array<long>")], drop=["data"])
    every = materialize(found.withColumn("row", F.monotonically_increasing_id()))
    spread = every.select("row", F.explode(F.arrays_zip("places", "hashes")).alias("x")).select("row", F.col("x.places").alias("place"), F.col("x.hashes").alias("anchor"))
    again = spread.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    # A text has boundedly many anchors for its length, so the lists below are no longer than it.
    mine = spread.join(again, "anchor").groupBy("row").agg(F.collect_list(F.struct("place", "anchor")).alias("x"))
    mine = materialize(mine.join(every.select("row", "__did", "__dh"), "row").select("row", "__did", "__dh", F.col("x.place").alias("places"), F.col("x.anchor").alias("hashes")))
    suspects = _suspect(rows.select("__did", "__dh", "data"), mine).where("__maybe").drop("__maybe")
    around = materialize(suspects.join(mine, ["__did", "__dh"]))

    def places(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for row, text, at, anchors in zip(*[c.to_pylist() for c in batch.columns]):
            out += [(row, a, p >> 24, _context(text, p)[2]) for p, a in zip(at, anchors)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["row", "anchor", "place", "digest"])

    # Digests are written; contexts, each byte of which lies in several, go from the texts to the shuffle.
    members = materialize(around.select("row", "data", "places", "hashes").mapInArrow(per_batch(places), "row long, anchor long, place int, digest binary"))
    contexts = _contexts(around)
    # (Pairs are made distinct first: an anchor may have very many places.)
    crowded = members.select("anchor", "digest").distinct().groupBy("anchor").count().where(F.col("count") > max_contexts).select("anchor")
    crowded = materialize(crowded)
    plain, few = contexts, F.broadcast(crowded)  # at most one anchor in max_contexts places
    if not crowded.isEmpty():
        plain = contexts.join(few, "anchor", "left_anti")
    ranges = plain.repartition("anchor").sortWithinPartitions("anchor", "digest").mapInArrow(_sort_task(width, gram), "anchor long, digest binary, n long, ranges array<int>")
    if not crowded.isEmpty():
        ranges = ranges.unionByName(_crowded(contexts.join(few, "anchor", "left_semi"), width, gram))
    ranges = materialize(ranges)
    total = ranges.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = lookup(members, ranges, ["anchor", "digest"], "n", total, "inner")
    spans = met.select("row", F.transform("ranges", lambda x: x + F.col("place")).alias("ranges")).groupBy("row").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for row, did, dh, text, ranges in zip(*[c.to_pylist() for c in batch.columns]):
            edge = np.zeros(len(text) + 1, np.int32)
            np.add.at(edge, np.array(ranges[0::2]), 1)
            np.add.at(edge, np.array(ranges[1::2]), -1)
            gone = np.cumsum(edge[:-1]) > 0
            first = gone & ~np.append(False, gone[:-1])
            out.append((row, did, dh, int(gone.sum()), int(first.sum()), np.frombuffer(text, np.uint8)[~gone].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["row", "__did", "__dh", "n_removed", "n_spans", "kept"])

    joined = around.select("row", "__did", "__dh", "data").join(spans, "row")
    return every, joined.mapInArrow(per_batch(cut), "row long, __did long, __dh long, n_removed long, n_spans long, kept binary")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    every, changed = repeats(docs, id_col, text_col, **options)
    digests = changed.select("row", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")).dropDuplicates(["row"])
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return every.select("row", "doc_id", "n_bytes", "sha256").join(digests, "row", "left").select("doc_id", "n_bytes", none("n_removed"), none("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the repeated bytes taken out of their texts; no row is dropped."""
    _, changed = repeats(docs, id_col, text_col, **options)
    left = materialize(_readable(changed).dropDuplicates(["__did", "__dh"]))
    keyed = _suspect(docs.select(*[F.col(f"`{c}`") for c in docs.columns], *_keys(id_col, text_col)), left)
    text = F.coalesce("__kept", F.col(f"`{text_col}`")).alias(text_col)
    met = keyed.where("__maybe").join(left, ["__did", "__dh"], "left").select(*[text if c == text_col else F.col(f"`{c}`") for c in docs.columns])
    return keyed.where("not __maybe").select(*docs.columns).unionByName(met)


def _readable(changed: DataFrame) -> DataFrame:
    def start():
        return lambda kept: [pa.array([x.as_py().decode("utf-8", "ignore") for x in kept], pa.string())]

    return append(changed.select("__did", "__dh", "kept"), [F.col("kept")], start, [("__kept", "string")], drop=["kept"])
