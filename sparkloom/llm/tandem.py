"""Operator 11: maximal periodic runs of words, by the tandem-repeat method of Gusfield
and Stoye.

Each document is a string over its words.  Of it,

1. the blocks of its LZ factorisation (longest previous factors, from a suffix array) give at
   most three candidates a word, whose common extensions tell a set of squares that covers
   the leftmost occurrence of every square, up to rotation within a run;
2. these squares are marked in the suffix tree, those of each leftmost start bottom-up;
3. from each mark a walk over suffix links, one word at a time, reaches the square's rotations
   until one does not occur or is marked already: then the tree holds the whole vocabulary;
4. the leaves below each mark are the occurrences of its square, and occurrences of one period
   at consecutive words merge into a run.

Squares whose half is itself a power are left out from step 2 on: their rotations are powers
too, and a run is told by its smallest period.

A run of interest repeats its period ``times`` times or more, so most text cannot hold one,
which is told exactly before: within such a run of period q (after its first q words) every
gram of four words has come at most q words before, or, for q below four, every word has.
For each power of two the stretches of such words that are long enough are widened by what
the run may hold besides, and overlapping ones joined; steps 1 to 4 see these parts only, and
every run of interest lies whole in one of them.

Tasks work on Arrow batches, pieces of a few MB of whole texts at a time; memory follows
the longest text (some 200 bytes a word of its periodic parts).

Cases: a null text has no words; a null doc_id is no case for ``planted``; repeated rows give
repeated results; ties between runs go to the smallest start, then period; texts of any length
are whole; an empty table gives an empty result; extra columns do not matter.  Words are
compared by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right
from functools import cmp_to_key

import numpy as np
from pyspark.sql import DataFrame

from . import bytesops as B
from . import common as C

LARGE = np.int64(1) << 62
RUN = "struct<start: long, length: long, period: long>"


class Extensions:
    """Classes of equal substrings of each power-of-two length, in their order."""

    def __init__(self, word: np.ndarray):
        self.n = n = len(word)
        rank = np.unique(word, return_inverse=True)[1].astype(np.int64)
        self.ranks, size = [], 1
        while True:
            self.ranks.append(np.append(rank, -1).astype(np.int32))
            if size >= n or rank.max() == n - 1:
                break
            after = np.zeros(n, np.int64)
            after[: n - size] = rank[size:] + 1
            rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1]
            size *= 2
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)
        self.rank = rank

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words are equal from i and j on (i and j differ)."""
        out, i, j = np.zeros(len(i), np.int64), i.copy(), j.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            step = (self.ranks[k][i] == self.ranks[k][j]).astype(np.int64) << k
            i, j, out = i + step, j + step, out + step
        return out

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words are equal up to i and j, these included."""
        out, i, j = np.zeros(len(i), np.int64), i + 1, j + 1
        for k in range(len(self.ranks) - 1, -1, -1):
            a, b = i - (1 << k), j - (1 << k)
            fits = (a >= 0) & (b >= 0)
            step = (fits & (self.ranks[k][np.where(fits, a, 0)] == self.ranks[k][np.where(fits, b, 0)])).astype(np.int64) << k
            i, j, out = i - step, j - step, out + step
        return out


def smaller_beside(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest places before and after each with a smaller value (-1 and n where none)."""
    values, open_ = order.tolist(), []
    before, after = [-1] * len(values), [len(values)] * len(values)
    for at, value in enumerate(values):
        while open_ and values[open_[-1]] > value:
            after[open_.pop()] = at
        if open_:
            before[at] = open_[-1]
        open_.append(at)
    return np.array(before), np.array(after)


def blocks(lce: Extensions) -> np.ndarray:
    """Where the LZ blocks start: each is the longest factor that started before, or a new word."""
    n, order = lce.n, lce.order
    factor = np.zeros(n, np.int64)
    before, after = smaller_beside(order)
    for other in (before, after):
        has = np.flatnonzero((other >= 0) & (other < n))
        factor[order[has]] = np.maximum(factor[order[has]], lce.forward(order[has], order[other[has]]))
    out, at, longest = [], 0, factor.tolist()
    while at < n:
        out.append(at)
        at += max(1, longest[at])
    return np.array(out, np.int64)


def covering_squares(lce: Extensions) -> tuple[np.ndarray, np.ndarray]:
    """(start, half length) of squares that cover the leftmost ones."""
    h = blocks(lce)
    ends = np.append(h[1:], lce.n)
    size, later = ends - h, np.append(ends[1:], lce.n)
    found = []

    def each(n):
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(np.arange(len(h)), n), nth + 1

    # centre in the block, right end beyond it
    of, k = each(size)
    p = ends[of]
    q = p - k
    right, left = lce.forward(p, q), lce.backward(p - 1, q - 1)
    hit = (left + right >= k) & (right > 0)
    found.append((np.maximum(q - left, q - k + 1)[hit], k[hit]))
    # left end before the block
    of, k = each(np.minimum(later, lce.n - 1) - h)
    p = h[of]
    q = p + k
    right, left = lce.forward(p, q), lce.backward(p - 1, q - 1)
    start = np.maximum(p - left, p - k + 1)
    hit = (left + right >= k) & (right > 0) & (left > 0) & (start + k <= ends[of])
    found.append((start[hit], k[hit]))
    start, half = np.concatenate([s for s, _ in found]), np.concatenate([k for _, k in found])
    return start, half


def primitive(lce: Extensions, start: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Whether the half of each square is no power of something shorter."""
    most = int(half.max(initial=1))
    least = np.zeros(most + 1, np.int64)
    for p in range(2, most + 1):
        if p * p > most:
            break
        if not least[p]:
            part = least[p * p :: p]
            part[part == 0] = p
    least[least == 0] = np.arange(most + 1)[least == 0]
    out, rest = np.ones(len(start), bool), half.copy()
    while (on := np.flatnonzero(rest > 1)).size:
        p = least[rest[on]]
        shorter = half[on] // p
        out[on[lce.forward(start[on], start[on] + shorter) >= 2 * half[on] - shorter]] = False
        rest[on] //= p
    return out


class SuffixTree:
    """Nodes as lists: the depth in words, the leaves below (``low`` to ``high`` in suffix order),
    the parent, the smallest position below; a node's children lie side by side in suffix order."""

    def __init__(self, lce: Extensions, word: np.ndarray):
        n, order = lce.n, lce.order
        # a place past the end, for the link of a string of one word
        self.order, self.rank, self.word = order.tolist(), [*lce.rank.tolist(), 0], word.tolist()
        shared = lce.forward(order[:-1], order[1:]).tolist()
        # leaves are nodes 0 to n - 1, in suffix order
        depth, low, high, first = (n - order).tolist(), list(range(n)), list(range(1, n + 1)), order.tolist()
        parent = [-1] * n
        branches: list[list] = [[0, 0, []]]  # depth, low, children
        for leaf, d in enumerate([*shared, 0]):
            held = start = leaf
            while branches[-1][0] > d:
                at, start, kids = branches.pop()
                kids.append(held)
                held = len(depth)
                depth.append(at)
                low.append(start)
                high.append(leaf + 1)
                least = n
                for c in kids:
                    parent[c] = held
                    if first[c] < least:
                        least = first[c]
                first.append(least)
                parent.append(-1)
            if branches[-1][0] < d:
                branches.append([d, start, [held]])
            else:
                branches[-1][2].append(held)
        held = len(depth)
        depth.append(0)
        low.append(0)
        high.append(n)
        first.append(0)
        parent.append(-1)
        for c in branches[0][2]:
            parent[c] = held
        self.root, self.depth, self.low, self.high, self.first, self.parent = held, depth, low, high, first, parent
        own, lows = np.array(parent), np.array(low)
        kids = np.lexsort((lows, own))
        kids = kids[own[kids] >= 0]
        ends = np.searchsorted(own[kids], np.arange(len(parent) + 1)).tolist()
        self.child, self.child_low, self.kids_from = kids.tolist(), lows[kids].tolist(), ends
        where = np.array(self.order)[lows[kids]] + np.array(depth)[own[kids]]
        self.child_word = np.append(word, -1)[where].tolist()
        self.links: dict[int, int] = {held: held}

    def down(self, node: int, leaf: int, least: int) -> int:
        """The first node at depth ``least`` or more on the way from ``node`` to a leaf."""
        depth, kids_from, child_low, child = self.depth, self.kids_from, self.child_low, self.child
        while depth[node] < least:
            node = child[bisect_right(child_low, leaf, kids_from[node], kids_from[node + 1]) - 1]
        return node

    def link(self, node: int) -> int:
        """The node of an inner node's string less its first word."""
        way = []
        while node not in self.links:
            way.append(node)
            node = self.parent[node]
        to = self.links[node]
        for node in reversed(way):
            to = self.links[node] = self.down(to, self.rank[self.order[self.low[node]] + 1], self.depth[node] - 1)
        return to

    def rotated(self, node: int, size: int) -> int | None:
        """The node at or below the end of the string of ``size`` words that ends at ``node``
        or on the edge to it, its first word moved to its end; None where it does not occur."""
        start = self.order[self.low[node]]
        first, leaf = self.word[start], self.rank[start + 1]
        to = self.down(self.link(self.parent[node]), leaf, size - 1)
        if self.depth[to] >= size:
            return to if self.word[self.order[self.low[to]] + size - 1] == first else None
        a, b = self.kids_from[to], self.kids_from[to + 1]
        at = bisect_left(self.child_word, first, a, b)
        return self.child[at] if at < b and self.child_word[at] == first else None


def vocabulary(tree: SuffixTree, start: np.ndarray, half: np.ndarray) -> set[tuple[int, int]]:
    """(node, length) of every square, from a covering set."""
    at: dict[int, list[int]] = {}
    for s, k in zip(start.tolist(), half.tolist()):
        at.setdefault(s, []).append(2 * k)
    marks: set[tuple[int, int]] = set()
    for s, sizes in at.items():
        sizes, node = sorted(set(sizes)), tree.rank[s]
        while sizes and tree.first[node] == s:
            above = tree.depth[tree.parent[node]] if node != tree.root else -1
            while sizes and sizes[-1] > above:
                marks.add((node, sizes.pop()))
            node = tree.parent[node]
            if node < 0:
                break
    for node, size in list(marks):
        while (node := tree.rotated(node, size)) is not None and (node, size) not in marks:
            marks.add((node, size))
    return marks


def runs_of(word: np.ndarray) -> np.ndarray:
    """Rows (start, length, smallest period) of every maximal run of two periods or more."""
    none = np.zeros((0, 3), np.int64)
    if len(word) < 2:
        return none
    word = np.unique(word, return_inverse=True)[1]
    lce = Extensions(word)
    start, half = covering_squares(lce)
    own = primitive(lce, start, half)
    if not own.any():
        return none
    tree = SuffixTree(lce, word)
    marks = vocabulary(tree, start[own], half[own])
    low = np.array([tree.low[v] for v, _ in marks])
    n = np.array([tree.high[v] for v, _ in marks]) - low
    period = np.repeat(np.array([size // 2 for _, size in marks]), n)
    leaf = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
    at = lce.order[leaf]
    sort = np.lexsort((at, period))
    at, period = at[sort], period[sort]
    new = np.ones(len(at), bool)
    new[1:] = (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(at)) - 1
    out = np.stack([at[head], at[last] + 2 * period[head] - at[head], period[head]], 1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def distance_back(key: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """How far before each place the same key was last, LARGE where it was not."""
    out = np.full(len(key), LARGE)
    at = np.flatnonzero(valid)
    order = at[np.argsort(key[at], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]
    out[order[1:][same]] = (order[1:] - order[:-1])[same]
    return out


def candidate_parts(word: np.ndarray, off: np.ndarray, times: int, least: int) -> np.ndarray:
    """Rows (from, to) of disjoint parts, each within a document (words ``off[d]`` to
    ``off[d + 1]``), that hold every run of ``times`` (2 or more) periods and ``least`` words whole."""
    n = len(word)
    if not n:
        return np.zeros((0, 2), np.int64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    longest = int(np.diff(off).max())
    parts = []

    def stretches(near, size, before, after):
        edge = np.flatnonzero(np.diff(np.concatenate([[False], near, [False]])))
        a, b = edge[::2], edge[1::2]
        keep = b - a >= size
        a, b = a[keep], b[keep]
        if len(a):
            parts.append(np.stack([np.maximum(a - before, off[doc[a]]), np.minimum(b + after, off[doc[a] + 1])], 1))

    near = np.zeros(n, bool)
    for q in (1, 2, 3):
        near[q:] |= (word[q:] == word[:-q]) & (doc[q:] == doc[:-q])
    # the first words of a document never come before, so that no stretch goes over an end
    stretches(near, min(max(least, times * q) - q for q in (1, 2, 3)), 3, 0)
    if longest >= 4 * times and n > 3:
        gram = np.zeros(n, B.U)
        for i in range(4):
            gram[: n - 3] += B.mix(word[i : n - 3 + i] + B.powers(4)[0][i + 1])
        inside = np.zeros(n, bool)
        inside[: n - 3] = doc[3:] == doc[:-3]
        back = distance_back(gram + doc.astype(B.U) * B.U(0xD6E8FEB86659FD93), inside)
        k = 4
        while k * times <= longest:
            # k <= period < 2 * k
            stretches(back < 2 * k, max(least - 3, (times - 1) * k - 3, 1), 2 * k - 1, 3)
            k *= 2
    if not parts:
        return np.zeros((0, 2), np.int64)
    parts = np.concatenate(parts)
    parts = parts[np.argsort(parts[:, 0], kind="stable")]
    end = np.maximum.accumulate(parts[:, 1])
    head = np.ones(len(parts), bool)
    head[1:] = (parts[1:, 0] >= end[:-1]) | (doc[parts[1:, 0]] != doc[parts[:-1, 0]])
    at = np.flatnonzero(head)
    return np.stack([parts[at, 0], end[np.append(at[1:], len(parts)) - 1]], 1)


def plant(doc_id, n: int) -> tuple[int, int] | None:
    """The contract's planted repeat: from which word on and with which period."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _better(x, y) -> int:
    """Greater exponent first, then smaller start, then smaller period."""
    return (y[1] * x[2] - x[1] * y[2]) or (x[0] - y[0]) or (x[2] - y[2])


def _row(doc, words: list[bytes], runs: np.ndarray):
    rows = runs.tolist()
    if rows:
        drop = np.zeros(len(words) + 1, np.int64)
        np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
        np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
        words = [w for w, d in zip(words, np.cumsum(drop).tolist()) if not d]
    start, length, period = min(rows, key=cmp_to_key(_better)) if rows else (None,) * 3
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in rows)
    return doc, len(rows), start, length, period, rows and 1000 * length // period or None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest(), [dict(zip(("start", "length", "period"), r)) for r in rows]


def _remapped(words, at: tuple[int, int]) -> np.ndarray:
    a, p = at
    i = np.arange(len(words))
    i[a:] = a + (i[a:] - a) % p
    return i


@B.tidied
def _runs(batches, times, least, planted):
    import pyarrow as pa

    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs"]
    long = pa.int64()
    kinds = [None, long, long, long, long, long, pa.string(), pa.string(), pa.list_(pa.struct([("start", long), ("length", long), ("period", long)]))]
    for batch in batches:
        for first, n, buf, off in B.pieces(batch, "text"):
            ids = batch.column(0).slice(first, n).to_pylist()
            starts, ends = B.spans(B.NOT_SPACE[buf], off)
            word = B.span_hash(B.prefix(buf), starts, ends)
            at = np.searchsorted(starts, off)
            moved = {}
            for d in range(n):
                if planted and (how := plant(ids[d], int(at[d + 1] - at[d]))):
                    moved[d] = _remapped(range(at[d + 1] - at[d]), how)
                    word[at[d] : at[d + 1]] = word[at[d] : at[d + 1]][moved[d]]
            found: dict[int, list[np.ndarray]] = {}
            for a, b in candidate_parts(word, at, times, least).tolist():
                runs = runs_of(word[a:b])
                runs = runs[runs[:, 1] >= np.maximum(least, times * runs[:, 2])]
                if len(runs):
                    d = int(np.searchsorted(at, a, "right")) - 1
                    found.setdefault(d, []).append(runs + [a - at[d], 0, 0])
            rows = []
            for d in range(n):
                words = buf[off[d] : off[d + 1]].tobytes().split()
                if d in moved:
                    words = [words[i] for i in moved[d].tolist()]
                rows.append(_row(ids[d], words, np.concatenate(found[d]) if d in found else np.zeros((0, 3), np.int64)))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, k or batch.schema.field(0).type) for c, k in zip(cols, kinds)], names)


def periodic_runs(docs: DataFrame, times: int = 4, least: int = 6, planted: bool = False) -> DataFrame:
    """``doc_id, n_runs``, the run of greatest exponent (``start, length, period,
    exponent_milli``, null without a run), ``runs_sha256``, ``collapsed_sha256`` and all ``runs``
    of each document, for runs of ``times`` periods and ``least`` words or more.

    ``collapsed`` has of each run its first period only.  ``planted`` puts the contract's
    repeats into every tenth document first."""
    C.text_batches(docs.sparkSession)
    kind = f"doc_id {dict(docs.dtypes)['doc_id']}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<{RUN}>"
    return docs.select("doc_id", "text").mapInArrow(lambda it: _runs(it, times, least, planted), kind)
