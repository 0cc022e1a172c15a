"""Prefix tries against brute force."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from oddrows.llm import prefixes

TURNS = "conv_id long, turn int, role string, text string"


def brute(sequences):
    """{(depth, smallest member): row} from all prefixes of {conv_id: (ids, words)}."""
    members, kids = defaultdict(list), defaultdict(set)
    for c, (ids, words) in sequences.items():
        for d in range(len(ids) + 1):
            members[tuple(ids[:d])].append((c, words[d - 1] if d else 0, d == len(ids)))
            if d:
                kids[tuple(ids[: d - 1])].add(tuple(ids[:d]))
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += node not in kids
        saved[node] += (len(members[node]) - 1) * members[node][0][1]
        if node:
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    first = {node: min(m)[0] for node, m in members.items()}
    return {
        (len(node), first[node]): (
            first[node[:-1]] if node else None, len(m), len(kids[node]), leaves[node], saved[node],
            hashlib.sha256(",".join(str(c) for c in sorted(c for c, _, e in m if e)).encode()).hexdigest(),
        )
        for node, m in list(members.items())
    }


def rows_of(df):
    return {(r.depth, r.conv_id): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()}


def frame(spark, sequences):
    return spark.createDataFrame([(c, list(map(int, i)), list(map(int, w))) for c, (i, w) in sequences.items()], "conv_id long, ids array<long>, words array<int>")


@pytest.mark.parametrize("seed", range(3))
def test_trees_merged_over_any_cuts_are_those_of_brute_force(seed):
    """Sorted sequences cut anywhere, between equal ones too: the parts of the shards add up."""
    rng = np.random.default_rng(seed)
    for _ in range(150):
        n, width = int(rng.integers(1, 30)), int(rng.integers(1, 4))
        made = {c: [int(x) for x in rng.integers(0, width, rng.integers(0, 6))] for c in range(n)}
        sequences = {c: (ids, [3 * x + 1 for x in ids]) for c, ids in made.items()}
        rows = sorted((ids, c) for c, ids in made.items())
        cuts = sorted(set(rng.integers(0, n, rng.integers(0, 5)).tolist()) | {0})
        shards = [rows[a:b] for a, b in zip(cuts, [*cuts[1:], n])]
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        shared = [-1] + [common(a[-1][0], b[0][0]) for a, b in zip(shards, shards[1:])] + [-1]
        within = [common(x[0][0], x[-1][0]) for x in shards]
        total, parts, least = {}, defaultdict(list), {}
        for s, shard in enumerate(shards):
            held = []
            for ids, c in shard:
                if held and held[-1][0] == ids:
                    held[-1][2].append(c)
                else:
                    held.append((ids, sequences[c][1], [c]))
            for row in prefixes.shard_nodes(held, [(i, shared[i], within[i]) for i in range(s + 1)], shared[s + 1]):
                key = (row[1], row[2]) if row[2] is not None else None
                if key:
                    parts[key].append(row)
                else:
                    total[row[1], row[5]] = (row[3], *row[6:])
        for key, some in parts.items():
            least[key] = min(r[5] for r in some)
        for (depth, _), some in parts.items():
            ends = b",".join(r[-1] for r in some if r[-1])
            total[depth, min(r[5] for r in some)] = (some[0][3], None, *[sum(r[i] for r in some) for i in range(7, 11)], hashlib.sha256(ends).hexdigest().encode())
        got = {(d, c): (least[d - 1, owner] if owner is not None else up, *rest, ends.decode()) for (d, c), (owner, up, *rest, ends) in total.items()}
        assert got == brute(sequences)


def test_many_shards_hot_sequence_and_very_long_one(spark):
    rng = np.random.default_rng(7)
    made = {c: rng.integers(0, 4, rng.integers(0, 9)) for c in range(-200, 400)}
    made |= {c: np.array([1, 2, 3]) for c in range(1000, 1400)}  # one sequence of many conversations, over several shards
    made |= {5000: rng.integers(0, 4, 3000), 5001: np.zeros(900, int), 5002: np.zeros(901, int)}
    sequences = {c: (ids, ids + 2) for c, ids in made.items()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert rows_of(prefixes.prefix_trie(frame(spark, sequences))) == brute(sequences)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_odd_rows(spark):
    long = "word " * 200_000
    rows = [
        (1, 0, "user", "a b"), (1, None, "user", None), (1, None, None, "x"), (1, 2, "user", long), (2, 0, "user", "a b"), (2, 0, "user", "a b"),
        (20, 0, "user", ""), (20, 1, None, None), (None, 0, "user", "a"), (None, None, None, None), (-7, 1, "a", "\x85  "), (-7, 0, "ab", "c"), (-8, 0, "a", "bc"),
    ]
    extra = spark.createDataFrame([(*r, "x", "y", 3) for r in rows], f"{TURNS}, ids string, words string, owner int")
    sequences, known = prefixes.encode(extra)
    text = {r.id: (r.role, r.text) for r in known.collect()}
    assert len(text) == len(set(text.values())) and sorted(text) == sorted(text, key=lambda i: tuple(x.encode() for x in text[i]))
    got = {r.conv_id: ([text[i] for i in r.ids], r.words) for r in sequences.collect()}
    assert got == {
        1: ([("", "x"), ("user", ""), ("user", "a b"), ("user", long)], [1, 0, 2, 200_000]), 2: ([("user", "a b")] * 2, [2, 2]),
        20: ([("user", ""), ("", "")], [0, 0]), -7: ([("ab", "c"), ("a", "\x85  ")], [1, 2]), -8: ([("a", "bc")], [1]),
    }
    plain = {r.conv_id: (r.ids, r.words) for r in sequences.collect()}
    assert rows_of(prefixes.prefix_trie(sequences)) == brute(plain)


def test_rebuilt_conversations(spark):
    made = {c: ([100 * c + i for i in range(c % 5)], [1] * (c % 5)) for c in [*range(20, 60), 61, 85, -3]}
    made |= {0: ([], []), 3: ([7, 8, 9, 10], [1, 2, 3, 4])}
    got = {r.conv_id: (r.ids, r.words) for r in prefixes.rebuilt(frame(spark, made)).collect()}
    for c, (ids, words) in made.items():
        h, base = zlib.crc32(str(c).encode()) % 4, int(np.fix(c / 20)) * 20
        head = made.get(base, ([], []))
        assert got[c] == (head[0][:h] + ids[h:], head[1][:h] + words[h:])
    assert len(got) == len(made)


def test_empty_table(spark):
    sequences, known = prefixes.encode(spark.createDataFrame([], TURNS))
    assert prefixes.prefix_trie(sequences).count() == 0 and known.count() == 0
    nothing = spark.createDataFrame([(4, [], [])], "conv_id long, ids array<long>, words array<int>")
    assert rows_of(prefixes.prefix_trie(nothing)) == {(0, 4): (None, 1, 0, 1, 0, hashlib.sha256(b"4").hexdigest())}
