import re
from collections import defaultdict

import numpy as np
import pytest

from oddrows.llm import neardup
from tests.llm.conftest import DOC, prose


def brute_classes(rows):
    """Components of all pairs at the threshold; rows: (id, normal text)."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, (_, t) in enumerate(rows):
        for h in neardup.shingle_weights(t)[0].tolist():
            holders[h].append(i)
    for i, j in {(a, b) for held in holders.values() for a in held for b in held if a < b}:
        if find(i) != find(j) and neardup.similarity(rows[i][1], rows[j][1]) >= neardup.THRESHOLD:
            parent[find(j)] = find(i)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return {i: min(g) for g in groups.values() for i in g}


def test_classes_are_those_of_all_pairs(spark, small):
    rows = [tuple(r) for r in small.select("doc_id", neardup.normal()).collect()]
    got = {r["id"]: r["class_id"] for r in neardup.classes(small).collect()}
    assert got == brute_classes(rows)


def test_large_group_of_near_copies(spark):
    """Copies that are near the first text but not always near each other, and a chain."""
    base = prose(200, 9).split()
    rng = np.random.default_rng(1)
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        words = list(base)
        for at in rng.choice(len(words), 4, replace=False):
            words[at] = f"new{i}x{at}"
        rows.append((i, " ".join(words)))
    chain = list(prose(120, 11).split())
    for i in range(8):
        chain[i * 14 + 3] = f"link{i}"
        rows.append((1000 + i, " ".join(chain)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    assert got == brute_classes(rows)
    assert got[149] == 0 and got[1007] == 1000


def test_signatures_estimate_weighted_jaccard():
    words = prose(400, 3).split()
    a, b = " ".join(words), " ".join(words[:300] + words[:100])
    sign = lambda t, k: neardup.dart_minhash(*neardup.shingle_weights(t), k)
    share = (sign(a, 2048) == sign(b, 2048)).mean()
    assert abs(share - neardup.similarity(a, b)) < 0.05
    for text in ("one", "a a a a a a a a a", prose(3000, 4)):
        assert len(sign(" ".join(text.split()), 64)) == 64


def test_weights_count():
    x, y = "a b c d e " * 20, "a b c d e " * 5
    a, b = " ".join(x.split()), " ".join(y.split())
    assert neardup.similarity(a, b) < 0.3 and neardup.similarity(a, a) == 1.0


@pytest.mark.parametrize("frame", ["odd", "none"])
def test_odd_rows(frame, request):
    docs = request.getfixturevalue(frame)
    kept = neardup.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0, len(r["text"] or "")) for r in kept.collect())
    if frame == "none":
        assert ids == []
        return
    numbers = [i for no, i, _ in ids if not no]
    assert numbers == [1, 2, 3, 4, 7, 8, 9, 11, 11, 12, 13]  # the copy of 4 and 10 go; both texts of 11 stay
    assert sum(no for no, _, _ in ids) == 2


def test_skew_joins_do_not_expand_a_group(spark):
    """Copies of one text are one node: a hot group makes no pairs."""
    docs = spark.createDataFrame([(i, prose(60, 1)) for i in range(300)], "doc_id long, text string")
    rows = neardup.classes(docs).collect()
    assert {r["class_id"] for r in rows} == {0} and {r["copies"] for r in rows} == {300}
    assert neardup.deduplicate(spark.createDataFrame([(i, prose(60, 1), "en", "s", 1) for i in range(300)], DOC)).count() == 1


def test_rows_without_words_all_stay(spark):
    docs = spark.createDataFrame([(None, None), (None, ""), (None, ""), (3, " "), (3, " "), (4, "one word more"), (4, "one word more")], "doc_id long, text string")
    kept = [(r["doc_id"], r["text"]) for r in neardup.deduplicate(docs).collect()]
    assert sorted(kept, key=repr) == sorted([(None, None), (None, ""), (None, ""), (3, " "), (3, " "), (4, "one word more")], key=repr)


def test_many_texts_are_signed_and_checked_as_one_by_one():
    """Signatures of a batch and the check on prepared sets are those of each text and pair: short, repeated, long and odd texts."""
    rng = np.random.default_rng(13)
    words = [f"w{i}" for i in range(40)]
    texts = ["a", "a b", "a b c d e", "a a a a a a a a a a a a", " ".join(rng.choice(words, 3000))]
    texts += [" ".join(rng.choice(words[:9], n)) for n in (3, 4, 6, 30, 200) for _ in range(8)]
    base = rng.choice(words, 120)
    for cut in range(0, 60, 3):
        texts.append(" ".join([*base[cut:], *rng.choice(words, cut)]))
    for part in (texts[:1], texts[:2], texts):
        made = neardup.signed(part)
        alone = [neardup.dart_minhash(*neardup.shingle_weights(t)) for t in part]
        assert np.array_equal(made, alone) and np.array_equal(neardup.band_keys(made), [neardup.band_keys(s) for s in alone])
    sets = neardup.region_sets([*texts, *texts[::-1]])
    found = [[neardup.near(sets[a], sets[b]) for b in texts] for a in texts]
    assert found == [[neardup.similarity(a, b) >= neardup.THRESHOLD for b in texts] for a in texts] and 0 < sum(map(sum, found)) < len(texts) ** 2


def test_blanks_are_joined_as_before(spark):
    odd = ["a  b\t c", "\ta\x0b\x0cb \r\n", " A b ", "a\tb", "\n \t", "", "a   b", "a b c"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in odd], "text string").select(neardup.normal()).collect()]
    assert got == [re.sub("[\x20\x09-\x0d]+", " ", t.lower()).strip(" ") for t in odd]
