"""Near duplicates by DartMinHash signatures, a banded join, exact checks and connected components.

**Signature.** A text is the multiset of its five-word shingles; a shingle seen w times has the weight region [0, w). In
every unit of a region, darts fall at hashed ranks (a Poisson process of rate 1). A text with total weight W looks at the
darts below rank k (ln k + 2) / W: about k ln k in all, however long it is. Each dart belongs to a hashed coordinate, and
a coordinate keeps its earliest dart. Two texts agree in a coordinate with the probability of their weighted Jaccard
similarity. If a coordinate got no dart, the rank limit is doubled; the darts below the old one stay the same.

**Classes.** Equal texts are one node. Nodes that share a band are a bucket. A bucket is not expanded into pairs: the
nodes with the most company over all their buckets lead it, leaders are compared with the rest, and links join classes.
As long as a bucket has nodes of two classes that were not compared, it gets more leaders, sixteen times as many a round.
So each pair of a bucket is compared or is in one class already. A pair whose signatures agree in less than
``MIN_ESTIMATE`` (four deviations below the threshold) is not checked; all others are, by the exact similarity.

Defined cases: a text of fewer than five words is one shingle of all of them; null texts and texts without a word are
near nothing, each its own class; rows that repeat an id and a text are copies, of which one stays; equal ids with other
texts are separate; a null id is no representative if its class has another; an empty table gives no row; letter case
and the kind of white space do not matter; extra columns are carried along by ``deduplicate``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddrows.llm.common import append, lookup, materialize, per_batch, text_of

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4
SLOTS = BANDS * ROWS
MIN_ESTIMATE = 0.6
_MUL, _RADIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MUL
    x = (x ^ (x >> np.uint64(29))) * _RADIX
    return x ^ (x >> np.uint64(32))


def normal(text_col: str = "text") -> Column:
    """Lower-case words with single blanks between them."""
    # Single blanks, which are nearly all, are no match.
    return F.trim(F.regexp_replace(F.lower(text_of(text_col)), "\\x20[\\x20\\x09-\\x0D]+|[\\x09-\\x0D][\\x20\\x09-\\x0D]*", " "))


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_weights(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of a normal text, and how often each comes."""
    words = text.split(" ") if text else []
    h = word_hashes(words)
    width = min(SHINGLE, len(h))
    if width == 0:
        return h, np.zeros(0, np.int64)
    total = np.zeros(len(h) - width + 1, np.uint64)
    for i in range(width):
        total = _mix(total + h[i : len(h) - width + 1 + i])
    return np.unique(total, return_counts=True)


def similarity(a: str, b: str) -> float:
    """Weighted Jaccard similarity of two normal texts."""
    (x, m), (y, n) = shingle_weights(a), shingle_weights(b)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = np.minimum(m[i], n[j]).sum()
    total = m.sum() + n.sum() - shared
    return float(shared / total) if total else 0.0


def near(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the texts of two rising sets of weight regions are similar enough: the sets' Jaccard similarity is the weighted one."""
    if len(x) < len(y):
        x, y = y, x
    if len(y) / len(x) < THRESHOLD:
        return False
    shared = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return shared / (len(x) + len(y) - shared) >= THRESHOLD


def dart_minhash(hashes: np.ndarray, weights: np.ndarray, k: int = SLOTS) -> np.ndarray:
    """The earliest dart (its hash) of each of k coordinates."""
    many = np.repeat(np.arange(len(hashes)), weights)
    unit = np.arange(len(many)) - np.repeat(np.cumsum(weights) - weights, weights)  # 0 .. w-1 inside each region
    regions = _mix(hashes[many] + unit.astype(np.uint64) * _MUL)
    limit = k * (math.log(k) + 2) / len(regions)
    while True:
        ranks, darts = [], []
        alive, at, drawn = regions, np.zeros(len(regions)), 0
        step = max(1, math.ceil(limit))
        while len(alive):
            no = np.arange(drawn + 1, drawn + step + 1, dtype=np.uint64)
            dart = _mix(alive[:, None] + no[None, :] * _RADIX)
            gaps = -np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53)
            rank = at[:, None] + np.cumsum(gaps, axis=1)
            hit = rank < limit
            ranks.append(rank[hit])
            darts.append(dart[hit])
            on = hit[:, -1]
            alive, at, drawn = alive[on], rank[on, -1], drawn + step
        rank, dart = np.concatenate(ranks), _mix(np.concatenate(darts) ^ _MUL)
        order = np.lexsort((dart, rank))
        slot, first = np.unique((dart[order] % np.uint64(k)).astype(np.int64), return_index=True)
        if len(slot) == k:
            return dart[order][first]
        limit *= 2


def band_keys(signature: np.ndarray) -> np.ndarray:
    """Keys of the bands of one signature, or of many, a row each."""
    rows = signature.reshape(*signature.shape[:-1], BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:-1])
    for i in range(ROWS):
        key = _mix(key * _RADIX + rows[..., i])
    return key.view(np.int64)


def dart_minhashes(regions: np.ndarray, sizes: np.ndarray, k: int = SLOTS, times: float = 1.0) -> np.ndarray:
    """``dart_minhash`` of many texts at once: ``regions`` are the weight regions of the texts, ``sizes`` how many each has."""
    count = len(sizes)
    of, limits = np.repeat(np.arange(count), sizes), k * (math.log(k) + 2) * times / sizes
    best, first = np.full(count * k, np.inf), np.full(count * k, np.iinfo(np.uint64).max, dtype=np.uint64)
    alive, text, at, no = regions, of, np.zeros(len(regions)), 0
    found = []
    while len(alive):
        no += 1
        dart = _mix(alive + np.array([no], np.uint64) * _RADIX)
        rank = at - np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53)
        hit = np.flatnonzero(rank < limits[text])
        alive, text, at = alive[hit], text[hit], rank[hit]
        dart = _mix(dart[hit] ^ _MUL)
        found.append((text * k + (dart % np.uint64(k)).astype(np.int64), at, dart))
    place, rank, dart = (np.concatenate(c) for c in zip(*found))
    np.minimum.at(best, place, rank)
    mine = rank == best[place]
    np.minimum.at(first, place[mine], dart[mine])
    out = first.reshape(count, k)
    bare = np.flatnonzero(np.isinf(best).reshape(count, k).any(axis=1))
    if len(bare):  # a coordinate without a dart: the limit is doubled
        out[bare] = dart_minhashes(regions[np.isin(of, bare)], sizes[bare], k, 2.0 * times)
    return out


def regions_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The weight regions of texts that have words, one text after the other, and how many each has."""
    words = [t.split(" ") for t in texts]
    counts = np.array([len(w) for w in words])
    h = word_hashes([w for part in words for w in part])
    begins = np.cumsum(counts) - counts
    widths = np.minimum(counts, SHINGLE)
    total, following = np.zeros(len(h), np.uint64), np.concatenate([h, np.zeros(SHINGLE, np.uint64)])
    for i in range(SHINGLE):  # texts of fewer words end where their words do
        stays = slice(None) if widths.min() > i else np.repeat(widths > i, counts)
        total[stays] = _mix(total[stays] + following[i: i + len(h)][stays])
    sizes = counts - widths + 1
    shingles = total[np.arange(len(h)) - np.repeat(begins, counts) < np.repeat(sizes, counts)]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    for a, b in zip(starts.tolist(), ends.tolist()):
        shingles[a:b].sort()
    # The n-th of equal shingles of a text is the n-th unit of the shingle's region.
    place, run = np.arange(len(shingles)), np.ones(len(shingles), bool)
    run[1:] = shingles[1:] != shingles[:-1]
    run[starts] = True
    unit = place - np.maximum.accumulate(np.where(run, place, 0))
    return _mix(shingles + unit.astype(np.uint64) * _MUL), sizes


def signed(texts: list[str]) -> np.ndarray:
    """Signatures of texts that have words, a row each."""
    return dart_minhashes(*regions_of(texts))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """id, node (digest of the normal text; null without words), signature (16 bits a coordinate), band keys and the number of weight
    regions; if asked the normal text."""
    text = normal(text_col)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text")).select("id", "text", F.when(F.col("text") != "", F.unhex(F.md5("text"))).alias("node"))

    def start():
        def make(texts: pa.Array) -> list[pa.Array]:
            held = texts.to_pylist()
            some = [i for i, t in enumerate(held) if t]
            signs, bands, weights = [None] * len(held), [None] * len(held), [None] * len(held)
            if some:
                regions, sizes = regions_of([held[i] for i in some])
                made = dart_minhashes(regions, sizes)
                short = (made & np.uint64(0xFFFF)).astype("<u2")
                for i, sign, band, size in zip(some, short, band_keys(made).tolist(), sizes.tolist()):
                    signs[i], bands[i], weights[i] = sign.tobytes(), band, size
            return [pa.array(signs, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(weights, pa.int64())]

        return make

    return append(rows, ["text" if with_text else F.col("text")], start, [("signature", "binary"), ("bands", "array<long>"), ("weight", "long")], drop=[] if with_text else ["text"])


def _agreement(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, sa, sb) whose signatures agree often enough, with the share as ``estimate``."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        grid = lambda i: np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, SLOTS)
        share = (grid(2) == grid(3)).mean(axis=1)
        keep = pa.array(share >= MIN_ESTIMATE)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(share[share >= MIN_ESTIMATE])], names=["a", "b", "estimate"])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(per_batch(run, 8192, 1 << 24), "a binary, b binary, estimate double")


def region_sets(texts: list[str]) -> dict[str, np.ndarray]:
    """Each text's weight regions in rising order."""
    held = list(dict.fromkeys(texts))
    regions, sizes = regions_of(held)
    return {t: np.sort(regions[end - n: end]) for t, end, n in zip(held, np.cumsum(sizes).tolist(), sizes.tolist())}


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that have the exact similarity. Joins on a leader may be skewed; adaptive execution splits them."""
    ta, tb = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        # Texts are moved, as they take less than their regions when compressed; pairs of a leader lie together.
        x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        sets = region_sets([*x, *y])
        found = [near(sets[i], sets[j]) for i, j in zip(x, y)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.bool_())], names=["a", "b", "near"])

    return pairs.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb").mapInArrow(per_batch(run, 1024, 1 << 21), "a binary, b binary, near boolean")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b); the root is the smallest node of its component."""
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = None
    while True:
        # Each node points to its smallest neighbour or itself, then to what that one points to.
        near = materialize(both(edges).groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")))
        jump = materialize(near.join(near.select(F.col("a").alias("to"), F.col("to").alias("root")), "to").select(F.col("a").alias("node"), "root"))
        roots = jump if roots is None else materialize(
            roots.join(jump.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        )
        of = lambda c: jump.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))  # noqa: B023, E731
        edges = materialize(edges.join(of("a"), "a").join(of("b"), "b").where("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if edges.isEmpty():
            return roots


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document row: id, node, class_key (a node of its class), class_id (the smallest id of its class), copies
    (rows with this text). Texts without words have no node."""
    rows = materialize(signatures(docs, id_col, text_col, True))
    total = rows.count()
    nodes = materialize(rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id"), F.min(F.struct("signature", "bands", "weight")).alias("s")).select("node", "copies", "first_id", "s.signature", "s.bands", "s.weight"))
    placed = nodes.select("node", F.explode("bands").alias("bucket"))
    crowded = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = materialize(placed.join(crowded, "bucket"))
    company = members.groupBy("node").agg(F.sum("size").alias("company"))
    known = nodes.select("node", "signature", "weight")
    members = materialize(members.join(company, "node").join(known, "node"))
    wanted = members.select("node").distinct()
    texts = materialize(rows.select("node", "text").join(wanted, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text")))
    root = materialize(wanted.select("node", F.col("node").alias("root")))
    open_members, tried, leaders_each = members, None, 1
    while True:
        state = open_members.join(root, "node")
        busy = state.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket")
        state = materialize(state.join(busy, "bucket"))
        if state.isEmpty():
            break
        # One leader for each share of the bucket: an aggregate, not a window over the bucket.
        leaders = materialize(
            state.groupBy("bucket", F.pmod(F.xxhash64("node"), F.lit(leaders_each)).alias("__share")).agg(F.max(F.struct("company", "node", "signature", "root", "weight")).alias("l"))
            .select("bucket", F.col("l.node").alias("a"), F.col("l.signature").alias("sa"), F.col("l.root").alias("ra"), F.col("l.weight").alias("wa"))
        )
        # The smaller of two weights over the larger one is the most that their similarity can be.
        alike = F.least("weight", "wa") / F.greatest("weight", "wa") >= THRESHOLD
        pairs = state.join(leaders, "bucket").where("root != ra").where(alike).select(F.least("a", "node").alias("x"), F.greatest("a", "node").alias("y"), "a", F.col("node").alias("b"), "sa", F.col("signature").alias("sb"))
        found = _agreement(pairs).groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.max(F.struct("estimate", "a", "b")).alias("p")).select("p.*")
        if tried is not None:
            same = (F.least(found["a"], found["b"]) == tried["x"]) & (F.greatest(found["a"], found["b"]) == tried["y"])
            found = found.join(tried, same, "left_anti")
        checked = materialize(_verified(found, texts))
        links = checked.where("near")
        if not links.isEmpty():
            root = _merged(root, links)
        seen = checked.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        tried = seen if tried is None else tried.unionByName(seen)
        open_members = materialize(state.drop("root").join(leaders.select("bucket", F.col("a").alias("node")), ["bucket", "node"], "left_anti"))
        leaders_each *= 16
    first = root.join(nodes.select("node", "first_id"), "node")
    ids = first.groupBy("root").agg(F.min("first_id").alias("class_id"))
    by_node = nodes.select("node", "copies", "first_id").join(root, "node", "left").join(ids, "root", "left").select(
        "node", "copies", F.coalesce("root", "node").alias("class_key"), F.coalesce("class_id", "first_id").alias("class_id")
    )
    bare = rows.where(F.col("node").isNull()).select("id", "node", F.lit(None).cast("binary").alias("class_key"), F.col("id").alias("class_id"), F.lit(1).cast("long").alias("copies"))
    named = lookup(rows.where(F.col("node").isNotNull()).select("id", "node"), by_node, ["node"], "copies", total)
    return named.select("id", "node", "class_key", "class_id", "copies").unionByName(bare)


def _merged(root: DataFrame, links: DataFrame) -> DataFrame:
    """``root`` after joining the classes of linked nodes."""
    of = lambda c: root.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    between = materialize(links.select("a", "b").join(of("a"), "a").join(of("b"), "b").where("ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    if between.isEmpty():
        return root
    to = components(between).select(F.col("node").alias("root"), F.col("root").alias("next"))
    return materialize(root.join(to, "root", "left").select("node", F.coalesce("next", "root").alias("root")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that of the class's smallest id. Texts without words all stay, also where ids are null or repeat."""
    found = classes(docs, id_col, text_col)
    first = found.where(F.col("class_key").isNotNull()).groupBy("class_key").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "node")).alias("k")).select("k.id", "k.node")
    keep = first.select(F.coalesce("id", F.lit(0)).alias("__id"), F.col("id").isNull().alias("__no_id"), F.col("node").alias("__node"))
    text = normal(text_col)
    keyed = docs.withColumn("__t", text).select(
        *[F.col(f"`{c}`") for c in docs.columns], F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(0)).alias("__id"), F.col(f"`{id_col}`").isNull().alias("__no_id"),
        F.when(F.col("__t") != "", F.unhex(F.md5("__t"))).otherwise(F.lit(b"")).alias("__node"),
    )
    keys = ["__id", "__no_id", "__node"]
    bare = docs.where(text == "")
    return keyed.where(F.col("__node") != F.lit(b"")).join(keep, keys, "left_semi").dropDuplicates(keys).select(*docs.columns).unionByName(bare)
