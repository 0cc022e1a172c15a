import hashlib
from collections import Counter

import numpy as np
import pytest

from oddrows.llm import suffixes
from tests.llm.conftest import prose


def brute(rows, width=200):
    """(id, n_bytes, n_removed, n_spans, sha256) of every row, by counting every window."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(t[p : p + width] for _, t in texts for p in range(len(t) - width + 1))
    out = []
    for i, t in texts:
        edge = np.zeros(len(t) + 1, np.int64)
        for p in range(len(t) - width + 1):
            if counts[t[p : p + width]] > 1:
                edge[p] += 1
                edge[p + width] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(t) else 0
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def run(docs, **options):
    return sorted((tuple(r) for r in suffixes.report(docs, **options).collect()), key=repr)


def test_given_documents(spark, small):
    assert run(small) == brute([tuple(r) for r in small.select("doc_id", "text").collect()])


@pytest.mark.parametrize("most", [1, 4096])
def test_planted_passages(spark, most):
    """Overlapping, edge-of-text, exactly as long as the width, one byte too short, and self-repeating passages; with and
    without the path for crowded anchors."""
    p, q = prose(60, 21), "é" * 30 + prose(50, 22)
    rows = [
        (1, prose(40, 1) + p + prose(30, 2)), (2, p + prose(30, 3) + p[:220]), (3, prose(5, 4) + p[100:380] + q), (4, q), (5, q[20:]), (6, "z" * 450), (7, "ab" * 180),
        (8, prose(30, 5)[:100] + p[:200] + prose(30, 6)), (9, prose(30, 7)[:100] + q[-199:]), (10, prose(9, 8)), (11, "ab" * 99),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert run(docs, max_contexts=most) == brute(rows)


def test_texts_do_not_come_back_from_the_tasks_that_find_anchors(spark, monkeypatch):
    sent, whole = [], suffixes.append
    monkeypatch.setattr(suffixes, "append", lambda *args, **named: sent.append(whole(*args, **named)) or sent[-1])
    docs = spark.createDataFrame([(1, prose(60, 1)), (2, prose(60, 1)), (3, None)], "doc_id long, text string")
    assert run(docs) == brute([tuple(r) for r in docs.collect()])
    assert sent and all("data" not in df.columns for df in sent)


def test_long_texts_are_cut_in_blocks(monkeypatch):
    text = (prose(3000, 31) + prose(100, 32) + prose(2000, 33)).encode()
    whole = suffixes.text_anchors([text])[0]
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 5000)
    blocks = suffixes.text_anchors([text, b"short"])[0]
    assert whole.tolist() == blocks.tolist()
    place, _, first, last = whole
    assert (first <= place).all() and (last + 200 <= len(text)).all() and (last >= first).all()
    assert set(range(len(text) - 199)) == {i for a, b in zip(first, last) for i in range(a, b + 1)}  # every window has an anchor


def test_suffixes_are_sorted_and_collisions_are_told_apart(monkeypatch):
    rng = np.random.default_rng(2)
    stock = [bytes(rng.integers(97, 99, 336, dtype=np.uint8)) for _ in range(12)]
    contexts = [stock[i] for i in rng.integers(0, 12, 40)] + stock[:1]
    c = suffixes.Contexts(contexts, [136] * len(contexts), [0] * len(contexts))
    n = len(contexts)
    c.start = np.arange(n) * c.stride
    c.whole = c.sums[c.start + 200] - c.sums[c.start]
    order = c._sorted(np.zeros(n, np.int64), np.full(n, n))
    assert [contexts[i][:200] for i in order] == sorted(x[:200] for x in contexts)

    def want(rows):
        seen = Counter((s, x[s : s + 200]) for x in rows for s in range(137))
        return {(i, s) for i, x in enumerate(rows) for s in range(137) if seen[s, x[s : s + 200]] > 1}

    assert set(zip(*map(np.ndarray.tolist, c.repeated()))) == want(contexts)
    rows = [bytes([97 + i]) * 336 for i in range(3)]
    broken = suffixes.Contexts(rows, [136] * 3, [0] * 3)
    broken.sums[:] = 0  # every hash collides
    assert len(broken.repeated()[0]) == 0


@pytest.mark.parametrize("frame", ["odd", "none"])
def test_odd_rows(frame, request):
    docs = request.getfixturevalue(frame)
    assert run(docs) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    cut = suffixes.remove(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()


def test_cut_characters_leave_readable_text(spark):
    passage = "é" * 150
    rows = [(1, "a" + passage + prose(30, 1)), (2, "bc" + passage + prose(30, 2))]
    got = {r["doc_id"]: r["text"] for r in suffixes.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "a" + prose(30, 1), 2: "bc" + prose(30, 2)}


@pytest.mark.parametrize("most", [1, 4096])
def test_contexts_are_not_written(spark, monkeypatch, most):
    """Contexts overlap, so they take several times the room of their texts; only what is found in them is written."""
    written, whole = [], suffixes.materialize
    monkeypatch.setattr(suffixes, "materialize", lambda df: written.append(df.columns) or whole(df))
    rows = [(i, prose(9, i) + prose(60, 50) + prose(9, i + 20)) for i in range(5)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string"), max_contexts=most) == brute(rows)
    assert written and all("context" not in columns for columns in written)
