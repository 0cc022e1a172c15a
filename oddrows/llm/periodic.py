"""Runs of repeated words: a suffix automaton whose suffix-link tree is walked by link-cut access.

**Squares.** The words of a stretch are appended one after the other. In the link tree of its suffix automaton, the path
from word i's state to the root holds all suffixes that end at i; its states are coloured by the end of their last
occurrence. ``access`` makes that path one preferred path of colour i. On its way it meets the old preferred paths, each
entered at its deepest state that belongs to the new path: if that state is ``n`` words long and was last seen at j, then
the n words that end at j and at i are equal. With d = i - j <= n that is a square of period d, and period d holds for
the last n + d words. Preferred paths are splay trees, so a word costs amortised logarithmic time.

**Runs.** A square with n + d >= max(6, 4 d) words is extended to both sides as far as words d apart agree. A shorter
period of the stretch would have shown a later occurrence, so d is the smallest.

**Stretches.** After its first q words, every word of a run with period q occurred at most q words before, and at least
max(5, 3 q) such words follow each other. Words that cannot be among them are cut off by array operations first, so the
automaton reads only the rest with the words before it that a period could reach. This filter decides no run.

Defined cases: words are runs of characters other than ASCII white space; null, empty and blank texts have no words, no
run and an empty collapsed text; ids may be null, equal or missing: rows are handled one by one; repeated rows give
repeated results; an empty table gives no row; columns of the same names as the results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from oddrows.llm.common import append, text_of

LEAST_WORDS, LEAST_EXPONENT = 6, 4
FILTER_STEPS = 16  # the filter may stop at any step: it then leaves more to the automaton
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def suffix_links(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(link, length) of every state of the suffix automaton, and the state of each prefix. State 1 is the root, 0 is none.

    Most states have one way on, which is kept in two lists; only further ones need a dictionary.
    """
    link, length = [0, 0], [0, 0]
    first_word, first_state, others = [-1, -1], [0, 0], {}
    prefix, last = [], 1
    for n, w in enumerate(words, 1):
        state = len(link)
        link.append(1)
        length.append(n)
        first_word.append(-1)
        first_state.append(0)
        p, q = last, 0
        while p:
            if first_word[p] == w:
                q = first_state[p]
                break
            if first_word[p] < 0:
                first_word[p], first_state[p] = w, state
            else:
                more = others.get(p)
                if more is None:
                    others[p] = {w: state}
                elif w in more:
                    q = more[w]
                    break
                else:
                    more[w] = state
            p = link[p]
        if p:
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                clone = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                first_word.append(first_word[q])
                first_state.append(first_state[q])
                if q in others:
                    others[clone] = dict(others[q])
                while p:
                    if first_word[p] == w:
                        if first_state[p] != q:
                            break
                        first_state[p] = clone
                    else:
                        more = others[p]
                        if more[w] != q:
                            break
                        more[w] = clone
                    p = link[p]
                link[q] = link[state] = clone
        prefix.append(state)
        last = state
    return link, length, prefix


def squares(words: list[int]) -> list[tuple[int, int]]:
    """(end, period) of the squares of long enough stretches, once for each stretch of ends that follow each other."""
    link, length, prefix = suffix_links(words)
    up = link  # parent in the splay tree or, at its root, the state above the preferred path
    left, right, colour = [0] * len(link), [0] * len(link), [-1] * len(link)
    found, open_end = [], {}
    for i, v in enumerate(prefix):
        below = 0
        while v:
            # Splay v to the top of its preferred path, which keeps its colour at the top.
            y = up[v]
            if y and (left[y] == v or right[y] == v):
                while True:
                    z = up[y]
                    if z and (left[z] == y or right[z] == y):
                        top = up[z]
                        if left[z] == y:
                            if left[y] == v:  # rotate y over z, then v over y
                                b = right[y]
                                left[z] = b
                                if b:
                                    up[b] = z
                                right[y], up[z] = z, y
                                b = right[v]
                                left[y] = b
                                if b:
                                    up[b] = y
                                right[v], up[y] = y, v
                            else:  # v over y, then v over z
                                b, c = left[v], right[v]
                                right[y], left[z] = b, c
                                if b:
                                    up[b] = y
                                if c:
                                    up[c] = z
                                left[v], right[v] = y, z
                                up[y] = up[z] = v
                        elif right[y] == v:
                            b = left[y]
                            right[z] = b
                            if b:
                                up[b] = z
                            left[y], up[z] = z, y
                            b = left[v]
                            right[y] = b
                            if b:
                                up[b] = y
                            left[v], up[y] = y, v
                        else:
                            b, c = left[v], right[v]
                            right[z], left[y] = b, c
                            if b:
                                up[b] = z
                            if c:
                                up[c] = y
                            left[v], right[v] = z, y
                            up[z] = up[y] = v
                        up[v] = top
                        if top:
                            if left[top] == z:
                                left[top] = v
                            elif right[top] == z:
                                right[top] = v
                            else:
                                colour[v] = colour[z]
                                break
                        else:
                            colour[v] = colour[z]
                            break
                        y = top
                    else:
                        if left[y] == v:
                            b = right[v]
                            left[y] = b
                            right[v] = y
                        else:
                            b = left[v]
                            right[y] = b
                            left[v] = y
                        if b:
                            up[b] = y
                        up[y], up[v] = v, z
                        colour[v] = colour[y]
                        break
            seen = colour[v]
            if seen >= 0:
                d, n = i - seen, length[v]
                if n >= 3 * d and n + d >= LEAST_WORDS:
                    if open_end.get(d) != i - 1:
                        found.append((i, d))
                    open_end[d] = i
            deeper = right[v]
            if deeper:
                colour[deeper] = seen
            right[v] = below
            below, v = v, up[v]
        colour[below] = i
    return found


def stretches(gap: np.ndarray) -> list[tuple[int, int]]:
    """[from, to) of words that may be in runs, with the words before that a period could reach. ``gap``: words back to the
    same word, 0 for none."""
    alive = gap > 0
    for _ in range(FILTER_STEPS):
        edge = np.diff(np.concatenate(([0], alive.view(np.int8), [0])))
        start, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        size = end - start
        at = np.repeat(size, size)
        ok = (gap[alive] * (LEAST_EXPONENT - 1) <= at) & (at >= LEAST_WORDS - 1)
        if ok.all():
            break
        alive[alive] = ok
    else:
        edge = np.diff(np.concatenate(([0], alive.view(np.int8), [0])))
        start, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    return [(max(0, s - (e - s) // (LEAST_EXPONENT - 1)), e) for s, e in zip(start.tolist(), end.tolist())]


def extended(ids: np.ndarray, end: int, d: int) -> tuple[int, int]:
    """[from, to) of the longest stretch around ``end`` whose words d apart agree; reads twice its length at most."""
    start, step = end - d, 64
    while start > 0:
        low = max(0, start - step)
        differ = np.flatnonzero(ids[low:start] != ids[low + d : start + d])
        if len(differ):
            start = low + int(differ[-1]) + 1
            break
        start, step = low, 2 * step
    stop, step = end + 1, 64
    while stop < len(ids):
        high = min(len(ids), stop + step)
        differ = np.flatnonzero(ids[stop:high] != ids[stop - d : high - d])
        if len(differ):
            stop += int(differ[0])
            break
        stop, step = high, 2 * step
    return start, stop


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers >= 0, by start, then period."""
    if len(ids) < LEAST_WORDS:
        return []
    order = np.argsort(ids, kind="stable")
    same = np.flatnonzero(ids[order[1:]] == ids[order[:-1]])
    gap = np.zeros(len(ids), np.int64)
    gap[order[same + 1]] = order[same + 1] - order[same]
    runs, latest = set(), {}
    for lo, hi in stretches(gap):
        _, local = np.unique(ids[lo:hi], return_inverse=True)
        for end, d in squares(local.tolist()):
            end += lo
            start, stop = latest.get(d, (0, 0))
            if not start <= end < stop:
                latest[d] = start, stop = extended(ids, end, d)
                runs.add((start, stop - start, d))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapse(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    stays = np.ones(n, bool)
    for start, length, period in runs:
        stays[start + period : start + length] = False
    return stays


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter([known.setdefault(w, len(known)) for w in words], np.int64, len(words))


def find_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``, the words that
    stay when each run keeps its first period, with single blanks."""

    def start():
        def make(texts: pa.Array) -> list[pa.Array]:
            sizes, found, kept = [], [], []
            for text in texts.cast(pa.binary()).to_pylist():
                words = text.split()
                runs = runs_of(numbered(words))
                sizes.append(len(words))
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                if runs:
                    words = [words[i] for i in np.flatnonzero(collapse(len(words), runs)).tolist()]
                kept.append(b" ".join(words))
            return [pa.array(sizes, pa.int64()), pa.array(found, RUNS), pa.array(kept, pa.binary()).cast(pa.string())]

        return make

    return append(docs, [text_of(text_col)], start, [("n_words", "long"), ("runs", "array<struct<start: long, length: long, period: long>>"), ("collapsed", "string")])
