import pickle
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddrows.llm import toxicity
from tests.llm.conftest import prose


def test_search_is_exact():
    rng = np.random.default_rng(3)
    terms = [f"t{i}".encode() for i in range(40)]
    n = 500
    index = toxicity.Index({w: i for i, w in enumerate(terms)}, rng.uniform(1, 4, 40), np.arange(n), rng.integers(0, 2, n).astype(float), np.ones(n), 0.2)
    bags = [{int(t): int(rng.integers(1, 5)) for t in rng.choice(40, rng.integers(0, 6), replace=False)} for _ in range(n)]
    vectors = [index.vector(b) for b in bags]
    index.build(vectors)
    dense = np.zeros((n, 40))
    for i, (t, v) in enumerate(vectors):
        dense[i, t] = v
    for i in range(0, n, 7):
        if not len(vectors[i][0]):
            continue
        d, c = index.nearest(*vectors[i], 20, without=i)
        cosine = dense @ dense[i]
        cosine[i] = 0
        best = np.sort(cosine[cosine > 1e-12])[::-1][:20]
        assert np.allclose(c, best) and np.allclose(cosine[d], c)


def test_batches_of_queries_are_searched_exactly():
    """Common terms, which are multiplied in single precision, and terms with postings; equal texts get equal cosines in any batch."""
    rng = np.random.default_rng(5)
    words = [f"t{i}".encode() for i in range(200)]
    n = 900
    index = toxicity.Index({w: i for i, w in enumerate(words)}, rng.uniform(1, 4, 200), np.arange(n), rng.integers(0, 2, n).astype(float), np.ones(n), 0.2)
    texts = [b" ".join(words[int(t)] for t in np.minimum(rng.geometric(0.03, rng.integers(0, 30)) - 1, 199)).decode() + " Other" * (i % 3) for i in range(n)]
    index.build([index.vector(index.bag(t)[0]) for t in texts])
    assert 0 < index.common.shape[1] < 200 and len(index.docs)
    vectors = [toxicity._over_norm(t, v, own + other) for t, v, own, other in index.bags(texts)]
    dense = np.zeros((n, 200))
    for i, (t, v) in enumerate(vectors):
        dense[i, t] = v
    whole = np.array([index.vector(index.bag(t)[0]) for t in texts], object)
    examples = np.zeros((n, 200))
    for i, (t, v) in enumerate(whole):
        examples[i, t] = v
    found = index.search(vectors, 20)
    for i, (d, c) in enumerate(found):
        cosine = examples @ dense[i]
        best = np.sort(cosine[cosine > 0])[::-1][:20]
        assert np.allclose(c, best, rtol=1e-12) and np.allclose(cosine[d], c, rtol=1e-12)
        if i % 50 == 0:
            alone = index.bags([texts[i]])[0]
            assert all(np.array_equal(a, b) for a, b in zip(index.search([toxicity._over_norm(*alone[:2], alone[2] + alone[3])], 20)[0], found[i]))


def test_texts_meet_python_twice_only(planted):
    """Once for their rare words and once for the search, whatever is carried; the scores are made from the search's result alone."""
    docs, labels = planted
    index = toxicity.fit(docs, labels.where(~toxicity.held_out()), max_examples=200, max_known=1)
    assert index.rare is not None
    for carry in (None, ["doc_id"]):
        tree = toxicity.score(docs.limit(9), index, carry=carry)._jdf.queryExecution().analyzed().toString()
        assert tree.count("MapInArrow") == 2
    # Looking for words takes neither postings nor examples to the tasks.
    texts = [r["text"] for r in docs.limit(50).collect()]
    assert len(pickle.dumps(index.words())) < len(pickle.dumps(index.compact())) / 2
    words = toxicity.counted(texts)[0].to_pylist()
    assert index.words().places(words) == index.compact().places(words) == index.places(words)


def test_tasks_hold_words_as_arrays(monkeypatch):
    words = [f"word{i}".encode() for i in range(50_000)]
    index = toxicity.Index({w: i for i, w in enumerate(words)}, np.ones(len(words)), np.arange(0), np.zeros(0), np.zeros(0), 0.2)
    index.build([])
    data = pickle.dumps(index.compact())
    tracemalloc.start()
    held = pickle.loads(data)
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert size < 64 * len(words)
    text = "word7 Word7 word49999 other word0 word50000"
    assert held.bag(text) == index.bag(text) == ({7: 2, 49_999: 1, 0: 1}, {b"other": 1, b"word50000": 1})
    assert toxicity.Words([]).places([b"a"]) == [-1] and toxicity.Words(words).places([]) == []
    monkeypatch.setattr(toxicity.Words, "hashed", staticmethod(lambda words: np.array([len(w) for w in words], np.uint64)))  # every hash collides
    assert toxicity.Words([b"aa", b"b", b"cc"]).places([b"cc", b"aa", b"dd", b"b", b"eee"]) == [2, 0, -1, 1, -1]


@pytest.fixture(scope="module")
def planted(spark):
    rows, labels = [], []
    for i in range(1200):
        words = prose(100, i).split()
        bad = i % 5 == 0
        if bad:
            words[10], words[40] = "idiot", "moron,"
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(planted):
    docs, labels = planted
    index = toxicity.fit(docs, labels.where(~toxicity.held_out()), max_examples=400)
    rows = toxicity.score(docs, index).where(toxicity.held_out()).join(labels, "doc_id").collect()
    assert len(rows) > 200
    for r in rows:
        assert 0 <= r["score"] <= 1 and (r["score"] >= toxicity.THRESHOLD) == (r["toxic"] == 1)
        assert all(e["label"] == r["toxic"] for e in r["evidence"])
    assert len(index.ids) <= 400


def test_a_text_is_sent_to_a_task_once(planted):
    docs, labels = planted
    index = toxicity.fit(docs, labels.where(~toxicity.held_out()), max_examples=200)
    for carry in (None, ["doc_id"]):
        tree = toxicity.score(docs.limit(9), index, carry=carry)._jdf.queryExecution().analyzed().toString()
        sent = next(line for line in tree[tree.index("MapInArrow") :].splitlines()[1:] if "Project" in line)
        assert len(re.findall(r"\btext#|\b__text#\d+ AS|coalesce\(cast\(text", sent)) <= 1 + (carry is not None), sent


def test_scores_are_calibrated(planted):
    docs, labels = planted
    noisy = labels.withColumn("toxic", F.when(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    index = toxicity.fit(docs, noisy.where(~toxicity.held_out()))
    got = toxicity.score(docs, index).join(labels.select("doc_id", F.col("toxic").alias("bad")), "doc_id").groupBy("bad").agg(F.avg("score").alias("s")).collect()
    mean = {r["bad"]: r["s"] for r in got}
    assert abs(mean[1] - 0.75) < 0.1 and abs(mean[0] - 0.25) < 0.1


def test_odd_rows(spark, odd, none, planted):
    docs, labels = planted
    index = toxicity.fit(docs, labels.unionByName(spark.createDataFrame([(None, 1, 1), (5, 0, None), (0, 0, 0)], labels.schema)))
    for frame in (odd, none):
        scored = toxicity.score(frame, index)
        assert scored.columns == [*[c for c in frame.columns if c != "score"], "score", "evidence"] and scored.count() == frame.count()
    assert toxicity.score(odd, index).where("score is null or score < 0 or score > 1").count() == 0
    for few in (labels.where("false"), labels.where("toxic = 0")):
        assert {r["score"] for r in toxicity.score(odd, toxicity.fit(docs, few)).collect()} == {0.0}


def test_cosines_are_over_whole_texts(spark):
    """Every word counts, also rare ones, those of both classes and those of no example; with and without the join of rare words."""
    words = [prose(60, i).split() + [f"only{i}", f"pair{i // 2}", f"seven{i // 7}"] for i in range(90)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(40)], "doc_id long, toxic int")
    df = Counter(w for x in words for w in set(x))
    idf = {w: np.log((1 + len(words)) / (1 + n)) + 1 for w, n in df.items()}
    told = {}
    for w in df:
        (b, a), (n0, n1) = [[sum(w in words[i] for i in range(40) if (i % 3 == 0) == y) for y in (False, True)], [26, 14]]
        chi2 = 40 * (a * (n0 - b) - b * (n1 - a)) ** 2 / (n1 * n0 * (a + b) * (40 - a - b)) if 0 < a + b < 40 else 0
        told[w] = 1 + chi2 * np.log((a + 1) * (n0 + 2) / ((b + 1) * (n1 + 2))) ** 2
    vectors = [{w: (1 + np.log(n)) * idf[w] * told[w] for w, n in Counter(x).items()} for x in words]
    norm = [np.sqrt(sum(v * v for v in x.values())) for x in vectors]
    made = []
    for known in (toxicity.MAX_KNOWN, 10):
        index = toxicity.fit(docs, labels, max_known=known)
        assert (index.rare is None) == (known > 10) and {w.encode() for x in words[:40] for w in x} <= set(index.terms)
        rows = {r["doc_id"]: r for r in toxicity.score(docs, index).collect()}
        assert len(rows) == len(words)
        for i, x in enumerate(vectors):
            cosine = [sum(v * y.get(w, 0.0) for w, v in x.items()) / norm[i] / norm[j] for j, y in enumerate(vectors[:40])]
            got = rows[i]["evidence"]
            assert np.allclose([e["cosine"] for e in got], sorted(cosine, reverse=True)[:3]) and np.allclose([cosine[e["doc_id"]] for e in got], [e["cosine"] for e in got])
        made.append([rows[i]["score"] for i in range(len(words))])
    assert np.allclose(*made)
