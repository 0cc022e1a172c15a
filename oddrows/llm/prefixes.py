"""A trie of conversation prefixes: ternary search trees over turn numbers in range shards, merged at their boundary nodes.

**Dictionary.** Every different turn (role, text) gets a number; numbers follow the order of (role, text). A conversation is
the sequence of its turns' numbers.

**Shards.** Sequences are sorted into ranges and written, so a shard is one stretch of the sorted order, and a sequence that
very many conversations share may lie in several shards. Each shard builds a ternary search tree: its different sequences
are inserted from the median outwards, which balances the search for a turn among its siblings. An iterative traversal then
adds up members, leaves and savings from the last node found to the first.

**Boundaries.** In sorted order a prefix that two shards share is a prefix of the last sequence of the one and the first of
the other. So the lengths in common between these, one row a shard, tell which nodes are shared, which shard has
one first (its owner) and whether a last node goes on. A shared node is a node and a child only for its owner, and the parts
of the shards then add up. Its parts meet under (depth, owner) and stream in the order of the shards, members' ids included.

Defined cases: turns are ordered by turn (null first), ties by role, then text; a null role or text is the empty one, and a
turn with an empty text is a turn; rows that repeat are turns of their own; rows without conversation id belong to none
and are left out; an empty table gives no node, also no root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddrows.llm.common import lookup, materialize, parallelism, text_of

WORD = r"[^\x20\x09-\x0D]+"
EMIT_ROWS = 4096
NODE_TEXT = (
    "shard int, depth int, owner int, parent_owner int, turn_id long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends binary"
)
_NAMES = [c.split()[0] for c in NODE_TEXT.split(", ")]
_TYPES = [pa.int32()] * 4 + [pa.int64()] * 7 + [pa.binary()]


def _digest(role: str = "role", text: str = "text") -> Column:
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), F.col(role), F.col(text)), 256))


def encode(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sequences, dictionary): conv_id, ids and words (of each turn) by conversation; id, role, text, words, n by different turn."""
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text_of("role").alias("role"), text_of("text").alias("text"))
    ranked = turns.groupBy("role", "text").agg(F.count(F.lit(1)).alias("n")).orderBy("role", "text")
    known = materialize(ranked.select(F.monotonically_increasing_id().alias("id"), "role", "text", F.regexp_count("text", F.lit(WORD)).alias("words"), "n", _digest().alias("digest")))
    total = turns.count()
    coded = lookup(turns.select("conv_id", "turn", _digest().alias("digest")), known.select("digest", "id", "words", "n"), ["digest"], "n", total, "inner")
    in_order = F.sort_array(F.collect_list(F.struct("turn", "id", "words")))
    sequences = coded.groupBy("conv_id").agg(in_order.alias("t")).select("conv_id", F.col("t.id").alias("ids"), F.col("t.words").alias("words"))
    return sequences, known.drop("digest")


def common_length(a: str, b: str) -> Column:
    """How many first elements two array columns share."""
    least = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), least), F.slice(b, F.lit(1), least), lambda x, y: x == y)
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, least).otherwise(first - 1).cast("int")


class Tree:
    """A ternary search tree of one shard. Node 0 is the root; ``parent`` is the trie's parent."""

    def __init__(self) -> None:
        self.turn, self.low, self.high, self.down = [-1], [0], [0], [0]
        self.parent, self.depth, self.words, self.ends = [-1], [0], [0], {}

    def _node(self, turn: int, parent: int, words: int) -> int:
        for column, value in ((self.turn, turn), (self.low, 0), (self.high, 0), (self.down, 0), (self.parent, parent), (self.depth, self.depth[parent] + 1), (self.words, words)):
            column.append(value)
        return len(self.turn) - 1

    def insert(self, turns: list[int], words: list[int], members: list[int]) -> None:
        at = 0
        for turn, n in zip(turns, words):
            x = self.down[at]
            if not x:
                x = self.down[at] = self._node(turn, at, n)
            while self.turn[x] != turn:
                side = self.low if turn < self.turn[x] else self.high
                if not side[x]:
                    side[x] = self._node(turn, at, n)
                x = side[x]
            at = x
        self.ends[at] = members

    def fill(self, sequences: list[tuple]) -> None:
        """Insert sorted (turns, words, members), the median first, then the medians of both halves and so on."""
        parts = [(0, len(sequences))]
        for lo, hi in parts:  # grows while it is read: breadth first
            mid = (lo + hi) // 2
            self.insert(*sequences[mid])
            parts += [p for p in ((lo, mid), (mid + 1, hi)) if p[0] < p[1]]

    def order(self) -> list[int]:
        """All nodes, each after its trie parent."""
        out, stack = [0], [self.down[0]]
        while stack:
            x = stack.pop()
            if x:
                out.append(x)
                stack += [self.low[x], self.high[x], self.down[x]]
        return out

    def path(self, turns: list[int]) -> list[int]:
        """The nodes of an inserted sequence, by depth, the root first."""
        out = [0]
        for turn in turns:
            x = self.down[out[-1]]
            while self.turn[x] != turn:
                x = self.low[x] if turn < self.turn[x] else self.high[x]
            out.append(x)
        return out


def owners(before: list[tuple[int, int, int]], depth: int) -> list[int]:
    """The shard that first has each of the first prefixes (0 to ``depth`` turns) of the last shard of ``before``. ``before``:
    (shard, turns its first sequence shares with the shard before, turns its first and last share); the first shares -1."""
    out, at = [], len(before) - 1
    for d in range(depth, -1, -1):
        while before[at][1] >= d and (at == len(before) - 1 or before[at][2] >= d):
            at -= 1
        out.append(before[at][0])
    return out[::-1]


def shard_nodes(sequences: list[tuple], before: list[tuple[int, int, int]], after: int) -> Iterator[tuple]:
    """Rows of NODE_TEXT: the part that the last shard of ``before`` has of each of its nodes. ``owner`` is set where a neighbour has the node too, and
    ``ends`` then holds the ids, else their digest. ``after``: turns shared with the next shard, -1 for none."""
    tree = Tree()
    tree.fill(sequences)
    order, (shard, shared, _) = tree.order(), before[-1]
    first, last = tree.path(sequences[0][0]), tree.path(sequences[-1][0])
    known = owners(before, len(first) - 1)
    owner = dict(zip(first[: shared + 1], known))
    for d, x in enumerate(last[: after + 1]):
        owner.setdefault(x, known[d] if d < len(first) and first[d] == x else shard)
    count = len(tree.turn)
    n, children, leaves, saved, least = [0] * count, [0] * count, [0] * count, [0] * count, [None] * count
    goes_on = last[-1] if after >= len(last) - 1 else -1
    for x in reversed(order):
        ends, mine = tree.ends.get(x), owner.get(x, shard) == shard
        if ends:
            n[x] += len(ends)
            least[x] = ends[0] if least[x] is None else min(least[x], ends[0])
        if not tree.down[x] and x != goes_on:
            leaves[x] += 1
        saved[x] += (n[x] - mine) * tree.words[x]
        up = tree.parent[x]
        if up >= 0:
            n[up] += n[x]
            children[up] += mine
            leaves[up] += leaves[x]
            saved[up] += saved[x]
            least[up] = least[x] if least[up] is None else min(least[up], least[x])
    for x in order:
        up, ends, own = tree.parent[x], ",".join(map(str, tree.ends.get(x, ()))).encode(), owner.get(x)
        ends = ends if own is not None else hashlib.sha256(ends).hexdigest().encode()
        yield (
            shard, tree.depth[x], own, owner.get(up), tree.turn[x] if x else None, least[x], least[up] if x and up not in owner else None, n[x], children[x], leaves[x], saved[x], ends,
        )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)


def _emitted(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if len(held) >= EMIT_ROWS or size > 1 << 24:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _shard_task(bounds: list[tuple[int, int, int, int]]):
    """Streams sorted (shard, ids, words, conv_id); holds one shard at a time."""
    at = {b[0]: i for i, b in enumerate(bounds)}
    before = [b[:3] for b in bounds]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def nodes(shard: int, held: list[tuple]) -> Iterator[tuple]:
            return shard_nodes(held, before[: at[shard] + 1], bounds[at[shard]][3])

        now, held = None, []
        for batch in batches:
            for shard, ids, words, conv_id in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if shard != now:
                    if held:
                        yield from _emitted(nodes(now, held))
                    now, held = shard, []
                if held and held[-1][0] == ids:
                    held[-1][2].append(conv_id)
                else:
                    held.append((ids, words, [conv_id]))
        if held:
            yield from _emitted(nodes(now, held))

    return task


def _merge_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the parts of shared nodes, sorted by (depth, owner, shard); holds one part at a time."""

    def merged() -> Iterator[tuple]:
        now, seen, some = None, None, False
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if now is None or (now[1], now[2]) != (row[1], row[2]):
                    if now is not None:
                        yield (*now, seen.hexdigest().encode())
                    now, seen, some = list(row[:-1]), hashlib.sha256(), False
                else:
                    now[5] = min(now[5], row[5])
                    for i in range(7, 11):
                        now[i] += row[i]
                if row[-1]:
                    seen.update((b"," if some else b"") + row[-1])
                    some = True
        if now is not None:
            yield (*now, seen.hexdigest().encode())

    yield from _emitted(merged())


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """One row a node of the trie of ``sequences`` (conv_id, unique; ids array<long>; words array<int>): turn_id (its last
    turn; root: null), conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (what
    keeping each prefix once saves in its subtree), ends_sha256 (of the ids of the conversations that end there)."""
    spark = sequences.sparkSession
    parts = parallelism(spark)
    ranged = sequences.select("ids", "words", "conv_id").repartitionByRange(parts, "ids", "conv_id").withColumn("shard", F.spark_partition_id())
    ranged = materialize(ranged)
    ends = ranged.groupBy("shard").agg(F.min("ids").alias("first"), F.max("ids").alias("last"))
    # One row a shard, so at most as many as there are partitions; the driver gets three numbers of each.
    ends = ends.withColumn("one", F.lit(0)).selectExpr("shard", "first", "last", "lag(last) OVER (PARTITION BY one ORDER BY shard) AS above", "lead(first) OVER (PARTITION BY one ORDER BY shard) AS below")
    lengths = ends.select("shard", F.coalesce(common_length("above", "first"), F.lit(-1)).alias("a"), common_length("first", "last").alias("b"), F.coalesce(common_length("last", "below"), F.lit(-1)).alias("c"))
    bounds = sorted(tuple(r) for r in lengths.collect())
    sorted_again = ranged.repartition(parts, "shard").sortWithinPartitions("shard", "ids", "conv_id").select("shard", "ids", "words", "conv_id")
    nodes = materialize(sorted_again.mapInArrow(_shard_task(bounds), NODE_TEXT))
    own = nodes.where(F.col("owner").isNull())
    shared = nodes.where(F.col("owner").isNotNull()).select(_NAMES).repartition("depth", "owner").sortWithinPartitions("depth", "owner", "shard")
    shared = materialize(shared.mapInArrow(_merge_task, NODE_TEXT))
    above = shared.select((F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent_owner"), F.col("conv_id").alias("above"), "n_children")
    columns = ["turn_id", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    below = own.where(F.col("parent_owner").isNotNull()).select(*columns, "parent_owner").unionByName(shared.where("depth > 0").select(*columns, "parent_owner"))
    met = lookup(below.withColumnRenamed("n_children", "n_own"), above, ["depth", "parent_owner"], "n_children", below.count(), "inner")
    met = met.withColumn("parent_conv_id", F.col("above")).drop("n_children").withColumnRenamed("n_own", "n_children")
    out = own.where(F.col("parent_owner").isNull()).select(columns).unionByName(met.select(columns)).unionByName(shared.where("depth = 0").select(columns))
    return out.withColumn("depth", F.col("depth").cast("long")).withColumn("ends_sha256", F.col("ends").cast("string")).drop("ends")


def rebuilt(sequences: DataFrame, group: int = 20, most: int = 3) -> DataFrame:
    """Sequences whose first 0 to ``most`` turns (by the id's crc32) are those of the first conversation of the id's group."""
    size = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most + 1)).cast("int")
    head = lambda c: F.slice(c, 1, most).alias(f"head_{c}")
    bases = sequences.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), head("ids"), head("words"))
    joined = sequences.withColumns({"base": F.col("conv_id") - F.col("conv_id") % group, "h": size}).join(bases, "base", "left")

    def mixed(c: str) -> Column:
        start = F.slice(F.coalesce(f"head_{c}", F.slice(c, 1, 0)), F.lit(1), F.col("h"))
        return F.concat(start, F.slice(c, F.col("h") + 1, F.size(c))).alias(c)

    return joined.select("conv_id", mixed("ids"), mixed("words"))
