import hashlib

import pytest

from oddrows.llm import parsing
from oddrows.llm.queries import QUERIES
from tests.llm.conftest import SMALL, prose


def names(text: bytes, level: int) -> set:
    return set(parsing.sketches([text], 10**9, (level,))[0].tolist())


def test_equal_substrings_share_inner_phrases_at_any_offset():
    shared = prose(300, 1).encode()
    a, b = names(b"x" * 3 + prose(50, 2).encode() + shared, 3), names(prose(81, 3).encode() + b"yy" + shared + prose(20, 4).encode(), 3)
    own = names(shared, 3)
    assert len(own - a) < 6 and len(own - b) < 6 and len(a & b) > len(own) - 8
    assert len(names(prose(300, 7).encode(), 3) & own) < len(own) / 10


def test_a_text_is_parsed_alike_in_any_company():
    texts = [prose(n, n).encode() for n in (1, 40, 3, 200)] + [b"a", b"aaaaaaaa", b"", b"abab" * 50]
    together = parsing.sketches(texts)
    for t, s in zip(texts, together):
        assert parsing.sketches([t])[0].tolist() == s.tolist() and (len(s) > 0) == (len(t) > 0)


def test_phrases_are_short():
    import numpy as np

    for raw in (prose(2000, 5).encode(), bytes(range(256)) * 20, b"a" * 5000, b"ab" * 3000):
        data = np.frombuffer(raw, np.uint8)
        after, _ = parsing.next_level(parsing._BYTES[data], np.array([0]), data)
        runs = 1 + int((data[1:] != data[:-1]).sum())
        assert runs / 17 <= len(after) <= max(1, runs / 2 + 1)


def test_query_by_brute_force(spark, small):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in small.collect()), reverse=True)
    got = {r["doc_id"]: r for r in QUERIES["op8_parsing_fingerprints"](spark, SMALL).collect()}
    assert len(got) == len(rows)
    for (i, text), (_, after) in zip(rows, [*rows[1:], rows[0]]):
        r, half = got[i], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, changed, following = (parsing.sketches([t.encode()])[0] for t in (text, edited, after))
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (parsing.to_text(own), parsing.to_text(changed))
        assert r["near_edited"] == parsing.likeness(own, changed) and r["near_next"] == parsing.likeness(own, following)
    rows = list(got.values())
    assert sum(r["near_edited"] for r in rows) / len(rows) > 0.25 > 0.05 > sum(r["near_next"] for r in rows) / len(rows)


def test_likeness_is_jaccard():
    a, b = parsing.sketches([prose(40, 1).encode(), (prose(20, 1) + prose(20, 9)).encode()], 10**6)
    assert parsing.likeness(a, b, 10**6) == len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    assert parsing.likeness(parsing.from_text(parsing.to_text(a)), a) == 1.0


@pytest.mark.parametrize("frame", ["odd", "none"])
def test_odd_rows(frame, request):
    docs = request.getfixturevalue(frame)
    rows = parsing.compare_with_edits(docs).collect()
    assert len(rows) == docs.count()
    assert sorted(r["n_chars"] for r in rows) == sorted(len(r["text"] or "") for r in docs.select("text").collect())
    assert parsing.fingerprints(docs).count() == docs.count()


def test_sketches_are_sorted_and_distinct_without_hashing(monkeypatch):
    """np.unique of numbers goes through a hash table, which took half of a task's time."""
    def slow(*_, **__):
        raise AssertionError("np.unique in the inner loop")

    monkeypatch.setattr(parsing.np, "unique", slow)
    texts = [prose(n, n).encode() * 2 for n in (1, 3, 40, 400)]
    for text, found in zip([*texts, b""], parsing.sketches([*texts, b""])):
        assert found.tolist() == sorted(set(found.tolist())) == parsing.sketches([text])[0].tolist() and len(found) <= parsing.SKETCH
