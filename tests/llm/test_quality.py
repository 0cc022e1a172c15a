import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddrows.llm import quality
from tests.llm.conftest import prose


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    held = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(held)


def check(docs):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = quality.judge(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = brute(r["text"])
        assert tuple(r[n] for n in names) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    return rows


def test_given_documents(small):
    rows = check(small)
    assert sum(r["kept"] for r in rows) > 0.7 * len(rows)


@pytest.mark.parametrize("frame", ["odd", "none"])
def test_odd_rows(frame, request):
    check(request.getfixturevalue(frame))


def test_windows_at_ends_and_overlaps(spark):
    texts = ["a b c a b c", "a b c d a b", "a a a a", "a a a", "x a b c y a b c z", "\x0b a\x0cb  c d a", "", "w"]
    check(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string"))


def test_estimate_resists_a_quarter_of_outliers(spark):
    rng = np.random.default_rng(5)
    good = rng.multivariate_normal([5, 5, 0.2, 0.3, 0.1], np.diag([1.0, 0.5, 0.04, 0.05, 0.05]) + 0.02, 3000)
    bad = rng.normal(0, 0.05, (700, 5)) + [9, 9, 2, 2, 2]
    rows = [("pair x", *map(float, x)) for x in np.vstack([good, bad])]
    df = spark.createDataFrame(rows, "__group string, " + ", ".join(f"{n} double" for n in quality.NAMES))
    found = quality.estimate(df, len(rows))
    e = found.collect()[0].asDict()
    centre = np.array([e[f"m_{n}"] for n in quality.NAMES])
    assert np.abs(centre - good.mean(0)).max() < 0.1
    w = np.array([[e[f"w_{i}_{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    far = lambda x: (((x - centre) @ w.T) ** 2).sum(1)
    assert (far(good) <= quality.CUT).mean() > 0.995 and (far(bad) > quality.CUT).all()
    # The written-out whitening is the inverse Cholesky factor of the shrunk scatter.
    assert np.allclose(np.linalg.inv(w.T @ w), np.cov(good.T), atol=0.25)


def test_junk_among_clean_texts_is_rejected(spark):
    clean = [(i, prose(120 + i % 80, i), "en", "s") for i in range(260)]
    junk = [(1000 + i, " | ".join(prose(80, i + 500).split()), "en", "s") for i in range(10)]
    rows = quality.judge(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")).collect()
    assert {r["kept"] for r in rows if r["doc_id"] < 1000} == {True}
    assert {r["kept"] for r in rows if r["doc_id"] >= 1000} == {False}


def test_plan_is_native(small):
    plan = quality.judge(small)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian"))
