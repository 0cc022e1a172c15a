"""Toxicity from the nearest labelled examples: exact TF-IDF cosine over an inverted index of all their words.

**Fit.** At most ``max_examples`` labelled rows become examples: of each class those with the smallest hash of the id,
weighted back to the class's share among all labelled rows. Every word of an example is indexed, whatever its label or count.
A word's weight is its TF-IDF times 1 + chi-square x ln(lift) ** 2 of its presence against the label over the examples: plain TF-IDF
finds texts of one subject, not of one label, so telling words weigh more (the lift keeps the common words of longer texts of one
class from counting as telling), but none weighs less than its TF-IDF. Document frequencies are of all documents: those of the examples' words, and of up to ``MAX_KNOWN`` words that no example has, are
broadcast.

**Search.** Words of many examples are rows of a dense matrix that is multiplied with the queries of a batch in single precision; the
postings of the others are added to that. What can be among the k nearest within that product's error bound is added up again
in double precision, so the k nearest are exact. A text's norm is over all its words. Words that are not broadcast count as in
one document; a join on the word corrects that for those in more (``rare``).

**Score.** Neighbours vote with 1 / (1.05 - cosine) times their class weight. Each example is scored without itself, and
isotonic regression of the labels on those votes makes votes into probabilities. ``evidence`` holds the nearest examples.

Defined cases: null and empty texts, and texts that share no word with an example, get the toxic share of the examples without
words; a word that no fitted document has counts as in one; labels that repeat an id count as toxic if one of them says so; null
labels are not used; without labels of both classes every score is the share of toxic labels (0 if there are none); ties in cosine
go by the example's place; rows that repeat get equal scores; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddrows.llm.common import append, materialize, per_batch, text_of

MAX_EXAMPLES = 8192
#: Words outside the examples whose document frequencies are broadcast.
MAX_KNOWN = 1 << 12
HELD_WORDS = 100_000
#: A word is common when more than one in ``COMMON`` examples has it.
COMMON = 8
#: Queries multiplied at once.
QUERIES = 64
NEIGHBOURS = 50
THRESHOLD = 0.3
_SPACE = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-case words, ASCII punctuation being space."""
    return _spaced(text).split()


def _spaced(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass").translate(_SPACE)


def counted(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The different words (``words_of``) of some texts; then text by text, which of them it has: text, word and how often."""
    split = pc.split_pattern(pa.array([_spaced(t) for t in texts], pa.binary()), " ")
    coded = split.flatten().dictionary_encode()
    words, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    key = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy())) * len(words) + code
    key, n = np.unique(key[pc.binary_length(words).to_numpy()[code] > 0], return_counts=True)
    return words, key // max(1, len(words)), key % max(1, len(words)), n


class Words:
    """Places of different words without an object a word: tasks that hold many words stay small. Words are found by hash and told
    apart by their bytes."""

    def __init__(self, words: list[bytes]) -> None:
        hashes = self.hashed(words)
        self.order = np.argsort(hashes, kind="stable").astype(np.int32)
        self.hashes, self.data = hashes[self.order], b"".join(words)
        self.ends = np.cumsum([0, *map(len, words)])
        self.ends = self.ends.astype(np.int32 if self.ends[-1] < 1 << 31 else np.int64)

    @staticmethod
    def hashed(words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))

    def places(self, words: list[bytes]) -> list[int]:
        """The place of each word, -1 where it is none of them."""
        if not len(self.hashes) or not words:
            return [-1] * len(words)
        wanted = self.hashed(words)
        order = np.argsort(wanted)  # neighbours are looked up together
        at = np.empty(len(words), np.int64)
        at[order] = np.searchsorted(self.hashes, wanted[order])
        near = np.minimum(at, len(self.hashes) - 1)
        met = np.flatnonzero(self.hashes[near] == wanted)
        out = np.full(len(words), -1)
        out[met] = place = self.order[near[met]]
        # One comparison of all bytes; word by word only where another word has the hash.
        begin = self.ends[place].astype(np.int64)
        size = self.ends[place + 1] - begin
        picked = [words[i] for i in met.tolist()]
        bytes_at = np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)
        if np.array_equal(size, np.fromiter(map(len, picked), np.int64, len(picked))) and np.frombuffer(self.data, np.uint8)[bytes_at].tobytes() == b"".join(picked):
            return out.tolist()
        for i, word in zip(met.tolist(), picked):
            same = self.order[at[i] : np.searchsorted(self.hashes, wanted[i], side="right")].tolist()
            out[i] = next((p for p in same if self.data[self.ends[p] : self.ends[p + 1]] == word), -1)
        return out.tolist()


@dataclass
class Index:
    """Examples by term. Terms without a posting are words that only other documents have."""

    terms: dict[bytes, int] | Words
    idf: np.ndarray  # times the factor for telling words
    ids: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float
    empty: float = 0.0
    once: float = 1.0  # idf of a word in one document
    rare: DataFrame | None = None  # (word, n) of words in several documents that are no terms
    starts: np.ndarray = field(default=None)  # term -> first posting
    docs: np.ndarray = field(default=None)
    values: np.ndarray = field(default=None)
    row: np.ndarray = field(default=None)  # term -> row of the common terms, -1: has postings
    common: np.ndarray = field(default=None)  # [example, row]
    single: np.ndarray | None = None  # common terms in single precision, [row, example]
    votes: np.ndarray = field(default=None)
    chances: np.ndarray = field(default=None)

    def weigh(self, t: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms in order and their weights, of terms and how often each is in a text."""
        order = np.argsort(t)
        return t[order], (1 + np.log(n[order])) * self.idf[t[order]]

    def vector(self, counts: dict[int, int], rest: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights over the whole text's norm; ``rest``: the sum of squares of words that are no terms."""
        t, v = self.weigh(np.fromiter(counts, np.int64, len(counts)), np.fromiter(counts.values(), np.float64, len(counts)))
        return _over_norm(t, v, (v * v).sum() + rest)

    def build(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Postings, and rows of the common terms, from the examples' vectors, in the examples' order."""
        t = np.concatenate([np.zeros(0, np.int64), *[v[0] for v in vectors]])
        d = np.repeat(np.arange(len(vectors)), [len(v[0]) for v in vectors]) if vectors else np.zeros(0, np.int64)
        w = np.concatenate([np.zeros(0), *[v[1] for v in vectors]])
        met = np.bincount(t, minlength=len(self.idf)) * COMMON > len(vectors)
        self.row = np.where(met, np.cumsum(met) - 1, -1).astype(np.int32)
        self.common, dense = np.zeros((len(vectors), int(met.sum()))), met[t]
        self.common[d[dense], self.row[t[dense]]] = w[dense]
        t, d, w = t[~dense], d[~dense], w[~dense]
        order = np.lexsort((d, t))
        self.docs, self.values = d[order].astype(np.uint16 if len(vectors) <= 1 << 16 else np.int32), w[order]
        self.starts = np.searchsorted(t[order], np.arange(len(self.idf) + 1)).astype(np.int32 if len(t) < 1 << 31 else np.int64)

    def nearest(self, t: np.ndarray, v: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k examples with the largest positive cosine."""
        return self.search([(t, v)], k, [without])[0]

    def search(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of each vector."""
        n, width = self.common.shape
        if not n:
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(vectors)
        if self.single is None:
            self.single = np.ascontiguousarray(self.common.T, np.float32)
        error, out = (width + 3) * 2.0**-24, []  # of a product of parts of unit vectors in single precision
        for at in range(0, len(vectors), QUERIES):
            part = vectors[at : at + QUERIES]
            weights = np.zeros((len(part), width))
            for i, (t, v) in enumerate(part):
                row = self.row[t]
                weights[i, row[row >= 0]] = v[row >= 0]
            rough = weights.astype(np.float32) @ self.single
            for i, (t, v) in enumerate(part):
                exact = self._added(t, v, n)
                total = exact + rough[i]
                if without is not None and without[at + i] >= 0:
                    total[without[at + i]] = 0
                may = total > 0
                if n > k:
                    # At least k examples reach the k-th of the largest of any columns.
                    few = total[: n // (4 * k) * 4 * k].reshape(-1, 4 * k).max(axis=0) if n > 16 * k else total
                    may &= total >= np.partition(few, -k)[-k] - 2 * error
                d = np.flatnonzero(may)
                c = exact[d] + (self.common[d] * weights[i]).sum(axis=1)  # row by row, whatever the batch
                order = np.lexsort((d, -c))[:k]
                out.append((d[order], c[order]))
        return out

    def _added(self, t: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
        """For every example, the sum over terms with postings."""
        starts = self.starts[t].astype(np.int64)
        size = self.starts[t + 1] - starts
        at = np.arange(size.sum()) + np.repeat(starts - np.cumsum(size) + size, size)
        return np.bincount(self.docs[at], self.values[at] * np.repeat(v, size), n) if len(at) else np.zeros(n)

    def vote(self, d: np.ndarray, c: np.ndarray) -> float:
        w = self.weights[d] / (1.05 - np.minimum(c, 1.0))
        return float(((w * self.labels[d]).sum() + self.prior) / (w.sum() + 1.0))

    def calibrate(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> None:
        """Isotonic regression (pool adjacent violators) of labels on leave-one-out votes."""
        full = [i for i, (t, _) in enumerate(vectors) if len(t)]
        bare = np.setdiff1d(np.arange(len(vectors)), full)
        mass = self.weights[bare].sum()
        self.empty = float(((self.weights[bare] * self.labels[bare]).sum() + self.prior) / (mass + 1.0))
        votes = np.array([self.vote(*near) for near in self.search([vectors[i] for i in full], k, full)])
        pools: list[list[float]] = []  # weight, weighted labels, smallest and largest vote
        for i in np.argsort(votes, kind="stable"):
            w = float(self.weights[full[i]])
            pools.append([w, w * float(self.labels[full[i]]), votes[i], votes[i]])
            while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
                w, y, _, hi = pools.pop()
                pools[-1] = [pools[-1][0] + w, pools[-1][1] + y, pools[-1][2], hi]
        self.votes = np.array([x for p in pools for x in (p[2], p[3])] or [0.0])
        self.chances = np.array([(p[1] + self.prior) / (p[0] + 1.0) for p in pools for _ in range(2)] or [self.prior])

    def judge(self, d: np.ndarray, c: np.ndarray, top: int = 3) -> tuple[float, list[dict]]:
        """Score and evidence from the nearest examples."""
        if not len(d):
            return self.empty, []
        chance = float(np.interp(self.vote(d, c), self.votes, self.chances))
        return min(1.0, max(0.0, chance)), [{"doc_id": int(self.ids[i]), "cosine": float(x), "label": int(self.labels[i])} for i, x in zip(d[:top], c[:top])]

    def places(self, words: list[bytes]) -> list[int]:
        """The term that each word is, -1: none."""
        return self.terms.places(words) if isinstance(self.terms, Words) else [self.terms.get(w, -1) for w in words]

    def bag(self, text: str) -> tuple[dict[int, int], dict[bytes, int]]:
        """How often each term is in a text, and each word that is no term."""
        counts = Counter(words_of(text))
        found = list(zip(counts.items(), self.places(list(counts))))
        return {t: n for (_, n), t in found if t >= 0}, {w: n for (w, n), t in found if t < 0}

    def bags(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, float, float]]:
        """Of each text: terms in order, weights, and the sums of squares of the weights of its terms and of its other words, these
        as if each were in one document. Sums do not depend on the other texts."""
        words, text, word, n = counted(texts)
        t = np.array(self.places(words.to_pylist()), np.int64)[word]
        size, width = len(self.idf), len(self.idf) + int(n.max(initial=0)) + 1
        order = np.argsort(text * width + np.where(t < 0, size + n, t))
        text, t, n = text[order], t[order], n[order]
        v = 1 + np.log(n)
        v *= np.append(self.idf, self.once)[t]
        own = t >= 0
        other = np.bincount(text[~own], v[~own] ** 2, len(texts)).tolist()
        text, t, v = text[own], t[own], v[own]
        square = np.bincount(text, v * v, len(texts)).tolist()
        edges = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
        return [(t[a:e], v[a:e], s, o) for a, e, s, o in zip(edges, edges[1:], square, other)]

    def compact(self) -> Index:
        """What tasks need, in arrays."""
        terms = self.terms if isinstance(self.terms, Words) else Words(sorted(self.terms, key=self.terms.get))
        return replace(self, terms=terms, rare=None, single=None)

    def words(self) -> Index:
        """What ``places`` needs."""
        return replace(self.judges(), terms=self.compact().terms, ids=None, labels=None, weights=None, votes=None, chances=None)

    def judges(self) -> Index:
        """What ``judge`` needs."""
        return replace(self.compact(), terms={}, idf=np.zeros(0), starts=None, docs=None, values=None, row=None, common=None)


def _over_norm(t: np.ndarray, v: np.ndarray, square: float) -> tuple[np.ndarray, np.ndarray]:
    return (t, v / np.sqrt(square)) if len(t) and square > 0 else (t[:0], v[:0])


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(4)) == 2


def _frequencies(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n): in how many documents each word is; a task sums what it can hold before the shuffle."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            words, _, word, _ = counted(batch.column(0).to_pylist())
            for w, n in zip(words.to_pylist(), np.bincount(word, minlength=len(words)).tolist()):
                if n:  # not the empty word between two blanks
                    held[w] += n
            if len(held) > HELD_WORDS:
                yield flush()
                held.clear()

        yield from per_batch(run)(batches)
        yield flush()

    return docs.select(text_of(text_col)).mapInArrow(task, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _bags(examples: DataFrame) -> pa.Table:
    """id, toxic, and each example's words with their counts."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        made = [Counter(words_of(t)) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array([list(c) for c in made], pa.list_(pa.binary())), pa.array([list(c.values()) for c in made], pa.list_(pa.int32())),
        ], names=["id", "toxic", "words", "counts"])

    return examples.select("__id", "toxic", "text").mapInArrow(per_batch(run), "id long, toxic int, words array<binary>, counts array<int>").toArrow()


def _telling(bags: pa.Table, terms: dict[bytes, int]) -> np.ndarray:
    """1 + chi-square x ln(lift) ** 2 of each term's presence against the label; 1 for a term that no example has."""
    seen, n = np.zeros((2, len(terms))), np.zeros(2)
    for batch in bags.select(["toxic", "words"]).to_batches(256):
        for r in batch.to_pylist():
            n[r["toxic"]] += 1
            seen[r["toxic"], [terms[w] for w in r["words"]]] += 1
    b, a = seen
    chi2 = n.sum() * (a * (n[0] - b) - b * (n[1] - a)) ** 2 / np.maximum(n[1] * n[0] * (a + b) * (n.sum() - a - b), 1)
    return 1 + chi2 * np.log((a + 1) * (n[0] + 2) / ((b + 1) * (n[1] + 2))) ** 2


def _known(counts: DataFrame, own: list[bytes], cut: int) -> pa.Table:
    """(word, n) of the words ``own`` and of those in at least ``cut`` documents."""
    shared = counts.sparkSession.sparkContext.broadcast(frozenset(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            yield batch.filter(pa.array([n >= cut or w in wanted for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], pa.bool_()))

    return counts.select("word", "n").mapInArrow(run, "word binary, n long").toArrow()


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_examples: int = MAX_EXAMPLES, max_known: int = MAX_KNOWN, k: int = NEIGHBOURS,
) -> Index:
    """The index over at most ``max_examples`` of ``labels`` (leave out rows that must not be learnt from before)."""
    known = labels.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").cast("long").alias("__id")).agg(F.max((F.col(f"`{label_col}`") > 0).cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    prior = sizes.get(1, 0) / max(1, sum(sizes.values()))
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("toxic") == y).orderBy(F.xxhash64("__id"), "__id").limit(max_examples // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    ids = F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in chosen.collect()], "__id long, toxic int"))  # at most max_examples rows
    # An id that repeats in the documents is an example once: the smallest text.
    examples = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), text_of(text_col).alias("text")).join(ids, "__id").groupBy("__id", "toxic").agg(F.min("text").alias("text"))
    used = {y: n for y, n in ((r["toxic"], r["count"]) for r in examples.groupBy("toxic").count().collect())}
    index = Index({}, np.zeros(0), np.zeros(0, np.int64), np.zeros(0), np.zeros(0), prior, prior)
    if len(used) < 2:
        index.build([])
        index.calibrate([], k)
        return index
    counts, n = materialize(_frequencies(docs, text_col)), docs.count()
    # The smallest power of two such that at most max_known words are in as many documents.
    held, power = {r["p"]: r["count"] for r in counts.groupBy(F.floor(F.log2("n")).alias("p")).count().collect()}, 1
    while sum(c for p, c in held.items() if p >= power) > max_known:
        power += 1
    cut = 2**power
    rows = _bags(examples).combine_chunks()  # bounded: the words of max_examples rows
    words = pa.chunked_array([c.flatten() for c in rows["words"].chunks], pa.binary())
    known = _known(counts, words.unique().to_pylist(), cut)
    index.terms = {w: i for i, w in enumerate(sorted(known["word"].to_pylist()))}
    index.idf = np.zeros(len(index.terms))
    index.idf[[index.terms[w] for w in known["word"].to_pylist()]] = np.log((1 + n) / (1 + known["n"].to_numpy())) + 1
    index.idf *= _telling(rows, index.terms)
    index.once = float(np.log((1 + n) / 2) + 1)
    index.rare = counts.where((F.col("n") > 1) & (F.col("n") < cut)) if cut > 2 else None
    vectors = {r["id"]: index.vector({index.terms[w]: c for w, c in zip(r["words"], r["counts"])}) for batch in rows.select(["id", "words", "counts"]).to_batches(256) for r in batch.to_pylist()}
    rows = sorted(rows.select(["id", "toxic"]).to_pylist(), key=lambda r: (r["id"] * 0x9E3779B97F4A7C15) % 2**64)
    index.ids = np.array([r["id"] for r in rows], np.int64)
    index.labels = np.array([r["toxic"] for r in rows], np.float64)
    share = {y: sizes[y] / used[y] for y in used}
    index.weights = np.array([share[r["toxic"]] for r in rows])
    index.weights /= index.weights.mean()
    ordered = [vectors[r["id"]] for r in rows]
    index.build(ordered)
    index.calibrate(ordered, k)
    return index


def _evidence(found: list[tuple[float, list[dict]]]) -> list[pa.Array]:
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
    return [pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], kind)]


def _each_text_once(make, texts: pa.Array, seen: dict[bytes, tuple]) -> list[tuple]:
    """``make`` of every text, which takes a list of them; equal texts of a task are worked on once."""
    texts = [t or "" for t in texts.to_pylist()]
    keys = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
    fresh = {key: t for key, t in zip(keys, texts) if key not in seen}
    if len(seen) + len(fresh) > 10_000:
        seen.clear()
        fresh = dict(zip(keys, texts))
    seen.update(zip(fresh, make(list(fresh.values()))))
    return [seen[key] for key in keys]


def score(docs: DataFrame, index: Index, text_col: str = "text", k: int = NEIGHBOURS, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (of it only ``carry``, if given) with score (0 to 1) and evidence (the nearest examples)."""
    shared = docs.sparkSession.sparkContext.broadcast(index.compact())  # bounded by the examples' words and max_known
    fields = [("score", "double"), ("evidence", "array<struct<doc_id: long, cosine: double, label: int>>")]
    columns = [c for c in (docs.columns if carry is None else carry) if c not in ("score", "evidence")]
    text, own = text_of(text_col), [F.col(f"`{c}`") for c in columns]
    # A text that stays in the result is its own input (null: empty); else it goes to the task and no further.
    stays = text_col in columns and docs.schema[text_col].dataType == T.StringType()
    given, extra = (text_col, []) if stays else (F.col("__text"), [text.alias("__text")])
    if index.rare is None:

        def start():
            index, seen = shared.value, {}

            def some(texts: list[str]) -> list[tuple[float, list[dict]]]:
                vectors = [_over_norm(t, v, square + other) for t, v, square, other in index.bags(texts)]
                return [index.judge(*near) for near in index.search(vectors, k)]

            return lambda texts: _evidence(_each_text_once(some, texts, seen))

        return append(docs.select(*own, *extra), [given], start, fields, drop=["__text"])

    # Rare words are in few documents, and so are the texts that have them: neither join has a hot key.
    words_only = docs.sparkSession.sparkContext.broadcast(index.words())
    keys = [F.xxhash64(text).alias("__k1"), F.xxhash64(F.lit("again"), text).alias("__k2")]

    def lines(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        index = words_only.value
        words, text, word, n = counted(batch.column(2).to_pylist())
        other = np.array(index.places(words.to_pylist()), np.int64)[word] < 0
        at = pa.array(text[other])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), words.take(pa.array(word[other])), pa.array(n[other], pa.int64())], names=["__k1", "__k2", "word", "tf"])

    # Dealt by word first, which serves both the distinct lines and the join. Words of one document need no correction and end here.
    other = docs.select(*keys, text.alias("__text")).mapInArrow(per_batch(lines), "__k1 long, __k2 long, word binary, tf long")
    once = F.lit(index.once)
    idf = once + F.log(2 / (1 + F.col("n")))
    corrected = F.sum(F.pow(1 + F.log("tf"), 2) * (idf * idf - once * once))
    rest = other.repartition("word").dropDuplicates(["__k1", "__k2", "word"]).join(index.rare, "word").groupBy("__k1", "__k2").agg(corrected.alias("__rest"))
    place = np.dtype("<u2" if len(index.ids) <= 1 << 16 else "<u4")

    def search():
        index, seen = shared.value, {}

        def some(texts: list[str]) -> list[tuple[bytes, bytes, float, float, bool]]:
            bags = index.bags(texts)
            near = index.search([_over_norm(t, v, square) for t, v, square, _ in bags], k)
            return [(d.astype(place).tobytes(), c.astype("<f4").tobytes(), square, other, other > 0) for (d, c), (_, _, square, other) in zip(near, bags)]

        def make(texts: pa.Array) -> list[pa.Array]:
            found = zip(*_each_text_once(some, texts, seen))
            return [pa.array(c, t) for c, t in zip(found, (pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.bool_()))]

        return make

    judges = docs.sparkSession.sparkContext.broadcast(index.judges())

    # Only what the score needs goes to Python again; the other columns wait.
    @F.arrow_udf("struct<score: double, evidence: array<struct<doc_id: long, cosine: double, label: int>>>")
    def finish(places: pa.Array, cosines: pa.Array, square: pa.Array, rest: pa.Array) -> pa.Array:
        part = [np.sqrt(s / (s + max(r, 0.0))) if s else 0.0 for s, r in zip(square.to_pylist(), rest.to_pylist())]
        found = [
            judges.value.judge(np.frombuffer(d, place).astype(np.int64), np.frombuffer(c, "<f4").astype(np.float64) * x)
            for d, c, x in zip(places.to_pylist(), cosines.to_pylist(), part)
        ]
        return pa.StructArray.from_arrays(_evidence(found), ["score", "evidence"])

    near = [("__places", "binary"), ("__cosines", "binary"), ("__square", "double"), ("__other", "double"), ("__open", "boolean")]
    searched = append(docs.select(*own, *keys, *extra), [given], search, near, drop=["__text"])
    # Texts without such words meet nothing; a number instead of their second key deals them out evenly.
    dealt = searched.withColumn("__k2", F.when(F.col("__open"), F.col("__k2")).otherwise(F.monotonically_increasing_id()))
    joined = dealt.join(rest, ["__k1", "__k2"], "left")
    # (Not deterministic: else a filter on the score would have it made twice.)
    made = finish.asNondeterministic()("__places", "__cosines", "__square", F.col("__other") + F.coalesce("__rest", F.lit(0.0)))
    return joined.select(*own, made.alias("__made")).select(*own, "__made.score", "__made.evidence")
