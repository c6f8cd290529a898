"""Operator 6: SimHash near duplicates through Golay-code fuzzy keys.

A fingerprint's 64 bits are three segments of 21, 21 and 22 bits, each a word of the
perfect binary Golay code of length 23 (padded with zeros).  Any word lies within 3
bits of exactly one codeword.  If x and y differ in one bit, the codeword nearest to
x lies within 4 bits of y, and y has at most 6 such codewords.  So a fingerprint is
stored under the index of its nearest codeword and looked up under those of all
codewords within 4 bits.

Up to 3 errors fall on three segments so that (pigeonhole)

* one segment has none and another at most one: six keys (exact, fuzzy); or
* each has one, and one half of the third segment has none: two keys (fuzzy, fuzzy,
  exact half).

Each key has over 30 bits of selectivity, so chance candidates stay few up to
billions of fingerprints.  Candidates are compared bit by bit.  Equal texts, and
unequal ones of equal fingerprint, are one node from the start.

Within a key the task compares the stored with the looked-up fingerprints and
returns only links that keep them connected, a number linear in their count.  A key
with more than ``crowd`` stored fingerprints is not compared there: its fingerprints
are linked through midpoints instead (x within 1 bit of z, y within 2 bits of z; any
two within 3 bits have such a z), which is exact and linear too.

similar_documents() is the same for a similarity instead of a number of bits.  Its
fingerprints have 256 bits, of which eight segments of 23 are Golay words.  Two words
within two bits share one of the codewords within 4 bits of either, so both sides are
stored under all of theirs (one or six), and keys are pairs of segments: one of four
pairs has to have both its words that close.  Words further apart often share one too.
Fingerprints that meet are compared whole: they are linked if they differ in no more
bits than those of texts of that similarity do on average.

Cases: a null or wordless text has fingerprint zero and is linked like any other; of
one or two words, the whole sequence is the only shingle; repeated rows and ties
share a node; texts of any length are taken whole; null doc_ids keep their rows and never name a component unless all are
null; empty tables give empty results; extra columns do not matter.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from . import common as C
from .components import connected_components

U = np.uint64
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Generator polynomial of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011

_tables: list[np.ndarray] = []


def _remainders() -> np.ndarray:
    """The 11-bit syndrome of each single bit of a word."""
    out = []
    for i in range(23):
        x = 1 << i
        for j in range(22, 10, -1):
            if x >> j & 1:
                x ^= GENERATOR << (j - 11)
        out.append(x)
    return np.array(out)


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, and for each syndrome the error
    patterns of weight 4 or less, nearest first (-1: none)."""
    if not _tables:
        single = _remainders()
        low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
        for i in range(12):
            low[np.arange(1 << 12) >> i & 1 == 1] ^= single[i]
        for i in range(11):
            high[np.arange(1 << 11) >> i & 1 == 1] ^= single[12 + i]
        near = np.full((2048, 6), -1, np.int64)
        used = np.zeros(2048, np.int64)
        for weight in range(5):
            for bits in combinations(range(23), weight):
                s = int(np.bitwise_xor.reduce(single[list(bits)])) if bits else 0
                if weight < 4 or bin(near[s, 0]).count("1") == 3:
                    near[s, used[s]] = sum(1 << b for b in bits)
                    used[s] += 1
        _tables.extend((low, high, near))
    return tuple(_tables)


def codewords(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word the 12-bit indices of the codewords within 4 bits, the
    nearest first (-1: no more)."""
    low, high, near = golay_tables()
    w = words.astype(np.int64)
    errors = near[low[w & 4095] ^ high[w >> 12]]
    return np.where(errors < 0, -1, (w[:, None] ^ errors) >> 11)


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the fingerprint, key, stored or looked up) of all keys."""
    part = [(fp >> U(at)) & U((1 << n) - 1) for at, n in SEGMENTS]
    index = [codewords(p) for p in part]
    out = []

    def emit(tag, exact, *fuzzy):
        rows = np.arange(len(fp))
        for cols in np.ndindex(*[f.shape[1] for f in fuzzy]):
            use = [f[:, c] for f, c in zip(fuzzy, cols)]
            ok = np.logical_and.reduce([u >= 0 for u in use])
            key = B.mix(exact[ok] * U(16) + U(tag))
            for u in use:
                key = B.mix(key ^ (u[ok].astype(U) + U(1)))
            out.append((rows[ok], key, np.full(ok.sum(), not any(cols))))

    tag = 0
    for x in range(3):
        for y in range(3):
            if x != y:
                emit(tag, part[x], index[y])
                tag += 1
    emit(6, part[2] & U(2047), index[0], index[1])
    emit(7, part[2] >> U(11), index[0], index[1])
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def _shingles(buf: np.ndarray, off: np.ndarray, shingle: int):
    """The text in its normal form and, for each document, its shingles: (bytes, start
    and end of each shingle, number of shingles of each document)."""
    buf = B.TO_LOWER[buf]
    mask = B.NOT_SPACE[buf]
    starts, ends = B.spans(mask, off)
    # one space after each word, other white space goes: a shingle is then one slice
    keep = mask.copy()
    keep[1:] |= mask[:-1]
    at = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    text = np.where(mask, buf, 32).astype(np.uint8)[keep]
    starts, ends = at[starts], at[ends - 1] + 1 if len(ends) else ends
    first = np.searchsorted(np.append(starts, len(text) + 1), at[off])
    words = np.diff(first)
    n = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    own = np.repeat(np.arange(len(n)), n)
    i = first[:-1][own] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    last = i + np.minimum(words[own], shingle) - 1
    return text, starts[i], ends[last], n


def _majority(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bits set in over half of a document's rows of 64-bit ``words``.  Counts of up to
    255 rows are added in bytes, eight at a time; a long document comes in parts."""
    lead = np.cumsum(n) - n
    parts = -(-n // 255)
    own = np.repeat(np.arange(len(n)), parts)
    begin = lead[own] + 255 * (np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts))
    end = np.minimum(begin + 255, (lead + n)[own])
    counts = np.zeros((len(n), 64 * words.shape[1]), np.int64)
    for a in range(0, len(own), 400):
        lo, hi = begin[a], end[min(a + 400, len(own)) - 1]
        bits = np.unpackbits(np.ascontiguousarray(words[lo:hi]).view(np.uint8), axis=1, bitorder="little")
        some = np.add.reduceat(bits.view(U), begin[a : a + 400] - lo, axis=0).view(np.uint8)
        docs = own[a : a + 400]
        first = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
        counts[docs[first]] += np.add.reduceat(some, first, axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view(U)


def _fingerprint_piece(buf: np.ndarray, off: np.ndarray, shingle: int, seed: int) -> np.ndarray:
    import xxhash

    text, starts, ends, n = _shingles(buf, off, shingle)
    text, digest = text.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter([digest(text[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist())], U, len(starts))
    return _majority(h[:, None], n)[:, 0]


@B.tidied
def _fingerprints(batches, shingle, seed):
    import pyarrow as pa

    for batch in batches:
        fp = [_fingerprint_piece(buf, off, shingle, seed) for _, _, buf, off in B.pieces(batch, "text", 2 << 20)]
        fp = np.concatenate(fp) if fp else np.zeros(0, U)
        keep = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], pa.array(fp.view(np.int64))], [*keep, "fp"])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp as a signed long of the same bits."""
    C.text_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(lambda it: _fingerprints(it, shingle, seed), f"doc_id {kind}, fp long")


@B.tidied
def _keys(batches):
    import pyarrow as pa

    for batch in batches:
        all_fp = batch.column(0).to_numpy().view(U)
        for a in range(0, len(all_fp), 2000):
            fp = all_fp[a : a + 2000]
            rows, key, stored = fuzzy_keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(~stored), pa.array(fp[rows].view(np.int64))], ["key", "asks", "fp"])


def _near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :]) <= bits


def _spanning(stored: np.ndarray, asking: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Edges that connect what is linked between the two, at most one for each node:
    labels are spread until they stand."""
    nodes = np.unique(np.concatenate([stored, asking]))
    at_s, at_a = np.searchsorted(nodes, stored), np.searchsorted(nodes, asking)
    label = np.arange(len(nodes))
    while True:
        old = label.copy()
        for i in range(0, len(at_a), 1024):
            part = at_a[i : i + 1024]
            near = _near(stored, asking[i : i + 1024], bits)
            np.minimum.at(label, part, np.where(near, label[at_s][:, None], len(nodes)).min(axis=0))
            np.minimum.at(label, at_s, np.where(near, label[part][None, :], len(nodes)).min(axis=1))
        if (label == old).all():
            break
    out = np.flatnonzero(label != np.arange(len(nodes)))
    return list(zip(nodes[out].tolist(), nodes[label[out]].tolist()))


@B.tidied
def _links(batches, bits, crowd):
    """Of rows sorted by key, the stored before the asking: (u, v, False) for links and
    (u, null, True) for fingerprints of a crowded key."""
    import pyarrow as pa

    def table(links, crowded):
        links = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        many = np.concatenate([np.unique(x) for x in crowded]) if crowded else np.zeros(0, np.int64)
        u = pa.array(np.concatenate([links[:, 0], many]))
        v = pa.array(np.concatenate([links[:, 1], many]))
        return pa.RecordBatch.from_arrays([u, v, pa.array(np.arange(len(u)) >= len(links))], ["u", "v", "crowded"])

    def finish(asks, fp):
        """One key's rows as far as they came; the stored ones stay for the rest."""
        stored = np.unique(fp[~asks])
        if len(stored) > crowd:
            return [], [fp]
        return _spanning(stored.view(U), np.unique(fp).view(U), bits), []

    rest: tuple = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
    for batch in batches:
        key, asks, fp = (np.concatenate([r, c.to_numpy(zero_copy_only=False)]) for r, c in zip(rest, batch.columns))
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        links, crowded = [], []
        if len(key) - cut > 4 * crowd + 20_000:
            # a very long key: what has come is settled, the stored stay
            got = finish(asks[cut:], fp[cut:])
            links += got[0]
            crowded += got[1]
            stay = cut + np.flatnonzero(~asks[cut:])[: crowd + 1]
        else:
            stay = np.arange(cut, len(key))
        rest = key[stay], asks[stay], fp[stay]
        more = _runs(key[:cut], asks[:cut], fp[:cut], finish)
        yield table(links + more[0], crowded + more[1])
    yield table(*_runs(*rest, finish))


def _runs(key, asks, fp, finish):
    links, crowded = [], []
    if not len(key):
        return links, crowded
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    end = np.append(begin[1:], len(key))
    # only keys with two fingerprints or more and a stored one
    some = (np.minimum.reduceat(fp, begin) != np.maximum.reduceat(fp, begin)) & ~asks[begin]
    for a, b in zip(begin[some].tolist(), end[some].tolist()):
        if b - a == 2:
            x, y = int(fp[a]) & 0xFFFFFFFFFFFFFFFF, int(fp[a + 1]) & 0xFFFFFFFFFFFFFFFF
            if (x ^ y).bit_count() <= 3:
                links.append((x, y))
            continue
        got = finish(asks[a:b], fp[a:b])
        links += got[0]
        crowded += got[1]
    return links, crowded


def _masks(least: int, most: int) -> np.ndarray:
    sets = [c for k in range(least, most + 1) for c in combinations(range(64), k)]
    return np.array([sum(1 << b for b in c) for c in sets], dtype=U)


@B.tidied
def _midpoints(batches):
    import pyarrow as pa

    near, far = _masks(0, 1), _masks(2, 2)
    for batch in batches:
        fp = batch.column(0).to_numpy().view(U)
        for a in range(0, len(fp), 64):
            part = fp[a : a + 64]
            for masks, close in ((near, True), (far, False)):
                z = (part[:, None] ^ masks[None, :]).reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(z.view(np.int64)), pa.array(np.repeat(part, len(masks)).view(np.int64)), pa.array([close] * len(z))], ["z", "fp", "close"])


def crowd_links(crowd: DataFrame) -> DataFrame:
    """Links among fingerprints (column fp) within 3 bits, through midpoints: a group
    of a midpoint has at most 2,081 fingerprints, whatever the crowd."""
    rows = crowd.select("fp").mapInArrow(_midpoints, "z long, fp long, close boolean")
    hubs = rows.groupBy("z").agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("hub"), F.collect_set("fp").alias("all")).filter("hub IS NOT NULL AND size(all) > 1")
    return hubs.select(F.explode("all").alias("u"), F.col("hub").alias("v")).filter("u != v").distinct()


def link_fingerprints(distinct: DataFrame, bits: int = 3, crowd: int = 4096) -> DataFrame:
    """(u, v): links that connect every two fingerprints within 3 bits."""
    n = C.partitions(distinct.sparkSession)
    rows = distinct.select("fp").repartition(n).mapInArrow(_keys, "key long, asks boolean, fp long")
    rows = rows.repartition(n, "key").sortWithinPartitions("key", "asks")
    found = C.stored(rows.mapInArrow(lambda it: _links(it, bits, crowd), "u long, v long, crowded boolean"), "links")
    links = found.filter("NOT crowded").select("u", "v").distinct()
    crowded = found.filter("crowded").select(F.col("u").alias("fp")).distinct()
    if not crowded.isEmpty():
        links = links.unionByName(crowd_links(crowded))
    return links


def _components(prints: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``prints`` with component_id; prints and nodes (with ``least``) have ``fp``."""
    parts = connected_components(links)
    nodes = nodes.join(parts, nodes["fp"] == parts["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("_c"))
    names = nodes.groupBy("_c").agg(F.min("least").alias("component_id"))
    return prints.join(nodes.join(names, "_c").select("fp", "component_id"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 3, crowd: int = 4096) -> DataFrame:
    """doc_id, fp, fingerprint (16 hex digits), component_id for each document."""
    if bits != 3:
        raise ValueError("the keys are made for 3 bits")
    prints = C.stored(fingerprints(docs, shingle), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    out = _components(prints, nodes, link_fingerprints(nodes, bits, crowd))
    return out.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


WIDE, PAIRS = ["f0", "f1", "f2", "f3"], 4


def _wide_piece(buf: np.ndarray, off: np.ndarray, shingle: int) -> np.ndarray:
    """256-bit fingerprints as [document][word]."""
    text, starts, ends, n = _shingles(buf, off, shingle)
    h = B.span_hash(B.prefix(text), starts, ends)
    return _majority(np.stack([B.mix(h + U(k * int(B.BASE) % (1 << 64))) for k in range(4)], axis=1), n)


def _node(fp: np.ndarray) -> np.ndarray:
    """One 64-bit name of a wide fingerprint."""
    out = B.mix(fp[:, 0])
    for k in range(1, 4):
        out = B.mix(out * U(3) ^ fp[:, k])
    return out


@B.tidied
def _wide_fingerprints(batches, shingle):
    import pyarrow as pa

    for batch in batches:
        fp = [_wide_piece(buf, off, shingle) for _, _, buf, off in B.pieces(batch)]
        fp = np.concatenate(fp) if fp else np.zeros((0, 4), U)
        cols = [_node(fp), *fp.T]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(c).view(np.int64)) for c in cols]], ["doc_id", "fp", *WIDE])


def _segment(fp: np.ndarray, at: int) -> np.ndarray:
    """23 bits of wide fingerprints from bit ``at``."""
    word, low = divmod(at, 64)
    out = fp[:, word] >> U(low)
    if low > 41:
        out |= fp[:, word + 1] << U(64 - low)
    return out & U((1 << 23) - 1)


def wide_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of the fingerprint, key) of all keys."""
    rows, keys, every = [], [], np.arange(len(fp))
    for pair in range(PAIRS):
        a, b = (codewords(_segment(fp, 23 * k)) for k in (2 * pair, 2 * pair + 1))
        for x, y in np.ndindex(6, 6):
            ok = (a[:, x] >= 0) & (b[:, y] >= 0)
            rows.append(every[ok])
            keys.append(pair << 24 | a[ok, x] << 12 | b[ok, y])
    return np.concatenate(rows), np.concatenate(keys)


@B.tidied
def _wide_rows(batches):
    import pyarrow as pa

    for batch in batches:
        for a in range(0, batch.num_rows, 2000):
            part = batch.slice(a, 2000)
            fp = np.stack([c.to_numpy() for c in part.columns], axis=1).view(U)
            rows, keys = wide_keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(keys), *[c.take(pa.array(rows)) for c in part.columns]], ["key", *WIDE])


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def _forest(fp: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Edges from the first of each component to its other members, by places in ``fp``:
    at most one for each, whatever the number of links."""
    near = np.empty((len(fp), len(fp)), bool)
    for i in range(0, len(fp), 64):
        near[i : i + 64] = _differ(fp[i : i + 64, None], fp[None]) <= limit
    left, out = np.ones(len(fp), bool), []
    for seed in range(len(fp)):
        if left[seed]:
            left[seed], front = False, np.array([seed])
            while len(front):
                met = np.flatnonzero(near[front].any(axis=0) & left)
                left[met] = False
                out += [(seed, int(x)) for x in met]
                front = met
    return out


LINKS = "u long, v long, key long, f0 long, f1 long, f2 long, f3 long"


def _settled(key: np.ndarray, fp: np.ndarray, limit: int) -> np.ndarray:
    """Links (as [link][two nodes]) among fingerprints of equal key, which are sorted."""
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(key)))
    few, found = np.repeat(size <= 8, size), [np.zeros((0, 2), np.int64)]
    for d in range(1, 8):
        # the rows of a short run, each with the d-th after it
        at = np.flatnonzero((key[d:] == key[:-d]) & few[d:]) if len(key) > d else np.zeros(0, np.int64)
        at = at[_differ(fp[at], fp[at + d]) <= limit]
        found.append(np.stack([at, at + d], axis=1))
    for a, n in zip(begin[size > 8].tolist(), size[size > 8].tolist()):
        found.append(a + np.array(_forest(fp[a : a + n], limit), np.int64).reshape(-1, 2))
    pairs, names = np.concatenate(found), _node(fp)
    out = names[pairs]
    return out[out[:, 0] != out[:, 1]]


@B.tidied
def _wide_links(batches, limit, crowd):
    """Of rows sorted by key: (u, v) of links, and (key, fingerprint) of keys with more
    than ``crowd`` rows."""
    import pyarrow as pa

    def table(links, key, fp):
        none = lambda n, kind=pa.int64(): pa.nulls(n, kind)
        join = lambda a, b: pa.concat_arrays([a, b])
        links = np.ascontiguousarray(links.view(np.int64))
        uv = [join(pa.array(links[:, i]), none(len(key))) for i in (0, 1)]
        rest = [join(none(len(links)), pa.array(np.ascontiguousarray(c).view(np.int64))) for c in (key, *fp.T)]
        return pa.RecordBatch.from_arrays([*uv, *rest], ["u", "v", "key", *WIDE])

    key, fp, open_ = np.zeros(0, np.int64), np.zeros((0, 4), U), None
    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy()])
        fp = np.concatenate([fp, np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1).view(U)])
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0
        many, at = [], np.arange(last)
        begin = np.flatnonzero(np.append(True, key[1:last] != key[: last - 1])) if last else at
        for a, b in zip(begin, np.append(begin[1:], last)):
            if b - a > crowd or key[a] == open_:
                many.append(np.arange(a, b))
        if len(key) - last > crowd or len(key) > last and key[-1] == open_:
            open_ = key[-1]
            many.append(np.arange(last, len(key)))
            last = len(key)
        out = np.concatenate(many) if many else np.zeros(0, np.int64)
        calm = np.setdiff1d(at, out)
        yield table(_settled(key[calm], fp[calm], limit), key[out], fp[out])
        key, fp = key[last:], fp[last:]
    yield table(_settled(key, fp, limit), key[:0], fp[:0])


@B.tidied
def _cell_links(batches, limit):
    """Of rows sorted by cell: links within each cell."""
    import pyarrow as pa

    key, fp = np.zeros(0, np.int64), np.zeros((0, 4), U)

    def table(links):
        links = np.ascontiguousarray(links.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["u", "v"])

    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy()])
        fp = np.concatenate([fp, np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1).view(U)])
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0
        yield table(_settled(key[:last], fp[:last], limit))
        key, fp = key[last:], fp[last:]
    yield table(_settled(key, fp, limit))


def wide_links(nodes: DataFrame, limit: int, crowd: int = 4096) -> DataFrame:
    """(u, v) of nodes: links that connect all fingerprints of a key within ``limit``
    bits.  The rows of a key with more than ``crowd`` are dealt into blocks of half as
    many, and each two blocks meet in a task of their own."""
    n = C.partitions(nodes.sparkSession)
    rows = nodes.select(*WIDE).repartition(n).mapInArrow(_wide_rows, "key long, f0 long, f1 long, f2 long, f3 long")
    rows = rows.repartition(n, "key").sortWithinPartitions("key")
    found = C.stored(rows.mapInArrow(lambda it: _wide_links(it, limit, crowd), LINKS), "wide-links")
    links = found.filter("u IS NOT NULL").select("u", "v").distinct()
    crowded = found.filter("key IS NOT NULL").select("key", *WIDE)
    if crowded.isEmpty():
        return links
    blocks = C.stored(crowded.groupBy("key").agg(F.ceil(F.count(F.lit(1)) * 2 / crowd).cast("int").alias("blocks")), "crowded-keys")
    own = F.pmod(F.xxhash64(*WIDE), F.col("blocks")).cast("int")
    cells = crowded.join(blocks, "key").withColumn("_b", own).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select(F.xxhash64("key", F.least("_b", "_j"), F.greatest("_b", "_j")).alias("cell"), *WIDE)
    met = cells.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(lambda it: _cell_links(it, limit), "u long, v long")
    return links.unionByName(met).distinct()


def bits_apart(similarity: float, bits: int = 256) -> int:
    """How many bits the fingerprints of two texts of equal length and this similarity
    (shared shingles over all of both) differ in, on average."""
    return math.floor(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, crowd: int = 4096) -> DataFrame:
    """doc_id, component_id for each document: components of texts whose similarity, as
    their fingerprints tell it, is ``similarity`` or more."""
    C.text_batches(docs.sparkSession)
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    prints = docs.select("doc_id", "text").mapInArrow(lambda it: _wide_fingerprints(it, shingle), f"doc_id {kind}, fp long, f0 long, f1 long, f2 long, f3 long")
    prints = C.stored(prints, "wide-fingerprints")
    nodes = C.stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in WIDE]), "wide-nodes")
    links = wide_links(nodes, bits_apart(similarity), crowd)
    return _components(prints.select("doc_id", "fp"), nodes.select("fp", "least"), links).select("doc_id", "component_id")
