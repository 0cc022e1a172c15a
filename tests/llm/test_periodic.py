"""Runs of repeated words against brute force."""

import zlib

import duckdb
import numpy as np
import pytest
from tests.llm.conftest import SMALL, odd_rows

from oddrows.llm import periodic
from oddrows.llm.queries import QUERIES

RUN = "start long, length long, period long"


def brute(ids):
    """All runs by comparing the sequence with itself at every distance."""
    ids, out = np.asarray(ids), []
    for q in range(1, len(ids) // 4 + 1):
        edge = np.diff(np.concatenate(([0], (ids[q:] == ids[:-q]).astype(np.int8), [0])))
        for i, j in zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist()):
            n, part = j - i + q, ids[i : j + q]
            if n >= max(6, 4 * q) and all((part[r:] != part[:-r]).any() for r in range(1, q)):
                out.append((i, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def words_of(text):
    return (text or "").encode().split()


@pytest.mark.parametrize("seed", range(6))
def test_runs_are_those_of_brute_force(seed):
    rng = np.random.default_rng(seed)
    for _ in range(300):
        w = rng.integers(0, rng.integers(1, 5), rng.integers(0, 60))
        for _ in range(rng.integers(0, 4)):  # periodic pieces, also nested and side by side
            a = rng.integers(0, len(w) + 1)
            w = np.concatenate([w[:a], np.resize(rng.integers(0, 6, rng.integers(1, 9)), rng.integers(0, 50)), w[a:]])
        assert periodic.runs_of(w) == brute(w), w.tolist()


def test_the_filter_decides_nothing():
    """The automaton over the whole sequence finds the same runs as over the stretches."""
    rng = np.random.default_rng(5)
    for _ in range(100):
        w = np.concatenate([rng.integers(0, 9, 40), np.resize(rng.integers(0, 9, 5), 33), rng.integers(0, 9, 40)])
        whole = {(*periodic.extended(w, end, d), d) for end, d in periodic.squares(w.tolist())}
        assert sorted((s, e - s, d) for s, e, d in whole) == sorted(periodic.runs_of(w))


def test_long_texts_take_linear_time():
    rng = np.random.default_rng(2)
    w = np.concatenate([np.zeros(200_000, np.int64), np.resize(np.arange(777), 100_000), np.repeat(rng.integers(0, 9, 20_000), 6)])
    runs = periodic.runs_of(w)
    assert (0, 200_001, 1) in runs and any(q == 777 and n == 100_000 for _, n, q in runs) and len(runs) > 15_000


def test_collapsed_text_keeps_the_first_period(spark):
    rows = spark.createDataFrame([(1, "a b a b a b a b c"), (2, "x x x x x"), (3, "x x\tx x\nx x y")], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic.find_runs(rows).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 8, 2)] and got[1].collapsed == "a b c"
    assert got[2].runs == [] and got[2].collapsed == "x x x x x"  # five words are no run
    assert [tuple(x) for x in got[3].runs] == [(0, 6, 1)] and got[3].collapsed == "x y"


def test_odd_rows(spark, odd, none):
    got = periodic.find_runs(odd).collect()
    assert len(got) == len(odd_rows()) and set(odd.columns) - {"n_words"} < set(got[0].asDict())
    for r in got:
        assert r.n_words == len(words_of(r.text)) and r.collapsed is not None
        assert r.runs == [] or r.doc_id == 12
    assert [tuple(x) for x in next(r for r in got if r.doc_id == 12).runs] == [(0, 2000, 1)]
    assert periodic.find_runs(none).count() == 0


def test_query_against_brute_force(spark):
    """Every document, with the periods that the query's contract plants."""
    import hashlib

    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, SMALL).collect()}
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    assert len(got) == len(rows)
    planted = 0
    for doc_id, text in rows:
        words, h = words_of(text), zlib.crc32(str(doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, planted = [words[i if i < a else a + (i - a) % p] for i in range(n)], planted + 1
        runs = brute(periodic.numbered(words))
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        r = got[doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest()
    assert planted > 5
