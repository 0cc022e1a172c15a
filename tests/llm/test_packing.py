import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oddrows.llm import packing
from oddrows.llm.queries import QUERIES, bpe_encoder
from tests.llm.conftest import SMALL


def check_layout(rows, capacity=packing.CAPACITY):
    """Gapless from 0 and within the capacity; gives the number of sequences."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(by)


def test_query_against_the_tokenizer_file(spark, small):
    import public_tokenizers as files
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    got = {(r["doc_id"], r["piece"]): r for r in QUERIES["op1_best_fit_packing"](spark, SMALL).collect()}
    want = {}
    for r in small.collect():
        ids = [*coder.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048)] if len(ids) > 2048 else [0]
        for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)])):
            want[r["doc_id"], k] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    assert {k: (r["start"], r["length"], r["ids_crc32"]) for k, r in got.items()} == want
    bins = check_layout(got.values())
    counts = np.bincount([r["length"] for r in got.values()], minlength=2049)
    bound = packing.lower_bound(counts, 2048)
    assert bound <= bins <= bound + 1


def test_special_and_other_letters_are_as_in_the_file():
    import public_tokenizers as files
    from tokenizers import Tokenizer

    coder, encode = Tokenizer.from_file(files.path("byte_bpe_50k.json")), bpe_encoder()()
    for text in ["a<|endoftext|>b", "漢字 かな 🙂", "naïve — “quotes” … ok", "x y  \n\n z's", "²³ ¼ ª", ""]:
        assert list(encode(text)) == coder.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bound_never_exceeds_the_best_packing(sizes):
    def best(items, rooms):
        if not items:
            return len(rooms)
        out = best(items[1:], [*rooms, 20 - items[0]])
        for i in {rooms.index(r) for r in rooms if r >= items[0]}:
            out = min(out, best(items[1:], [*rooms[:i], rooms[i] - items[0], *rooms[i + 1 :]]))
        return out

    exact = best(sorted(sizes, reverse=True), [])
    assert packing.lower_bound(np.bincount(sizes, minlength=21), 20) <= exact
    _, _, n = packing.best_fit_decreasing(np.array(sizes), 20)
    assert exact <= n


def test_bound_beats_the_sum_where_pieces_do_not_pair():
    counts = np.zeros(101, np.int64)
    counts[51] = 10
    assert packing.lower_bound(counts, 100) == 10


def test_exchange_between_small_partitions_reaches_the_bound(spark):
    rng = np.random.default_rng(3)
    sizes = np.concatenate([rng.integers(1, 100, 3000), [100] * 7])
    pieces = spark.createDataFrame([(i, int(x)) for i, x in enumerate(sizes)], "row long, length long")
    placed = packing.pack(pieces, 100, per_partition=100).join(pieces, "row").collect()
    assert len(placed) == len(sizes)
    bound = packing.lower_bound(np.bincount(sizes, minlength=101), 100)
    assert bound <= check_layout(placed, 100) <= bound + 2


def test_sequences_hold_the_ids(spark, small):
    pieces = packing.numbered(packing.tokenize_pieces(small.limit(50), bpe_encoder()))
    placed = packing.place(pieces)
    made = {r["sequence_id"]: r for r in packing.sequences(placed).collect()}
    for r in placed.collect():
        a = 4 * r["offset"]
        assert bytes(made[r["sequence_id"]]["ids"])[a : a + 4 * r["length"]] == bytes(r["ids"])


@pytest.mark.parametrize("frame", ["odd", "none"])
def test_odd_rows(frame, request):
    docs = request.getfixturevalue(frame)
    pieces = packing.tokenize_pieces(docs, bpe_encoder())
    rows = packing.place(packing.numbered(pieces.withColumn("crc", F.crc32("ids")).drop("ids"))).collect()
    check_layout(rows)
    assert sum(r["piece"] == 0 for r in rows) == docs.count()
    assert [r["length"] for r in rows if r["doc_id"] in (1, 2)] == ([1, 1] if rows else [])
