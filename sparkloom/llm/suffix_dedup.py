"""Operator 3: repeated byte strings, by longest-previous-factor arrays.

A string of ``length`` bytes is repeated if it starts anywhere else, in the same
document or another.  No task could sort all suffixes of a corpus, so they are dealt
out first so that equal strings meet:

1. Every window of ``length`` bytes has an anchor, the leftmost of its 64-byte grams of
   smallest hash, which depends on its bytes alone.  Consecutive windows of one anchor
   make a segment.  Equal windows have equal anchor grams, so windows are compared
   within an anchor gram only, and grams that occur once are done.
2. Equal segments are one segment with a count; all windows of one that occurs twice
   are repeated.
3. The different segments of a gram go to one task.  It puts their windows in suffix
   order (prefix doubling up to ``length`` bytes) and takes, for each, the previous and
   the next smaller position in that order; if either is reached over neighbours that
   share ``length`` bytes, the longest previous factor there is ``length`` or more.
   With ``keep="first"`` these later copies go and the first stays.  With
   ``keep="none"`` the first goes too: the same arrays on reversed positions tell.
4. A gram with more than ``crowd`` different segments is not gathered.  Its windows are
   split into blocks by their place before the anchor; blocks that share the bytes
   common to all their windows are grouped by hash, equal ones settled by counting, and
   what is still open is split again, down to single windows.  That is exact for any
   number of segments (128-bit hashes stand for bytes).

Cases: a null text is an empty one; texts shorter than ``length`` lose nothing; texts
of any length are cut in overlapping slices; repeated rows are copies of each other
(with ``keep="first"`` rows equal in doc_id and text keep or lose the same bytes); the
order of copies is doc_id, then row key, then place; empty tables give empty results;
columns with the names of the results, in any case, are replaced, other extra columns are
kept whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesops as B
from . import common as C

U = np.uint64
GRAM, SLICE, BITS = 64, 8 << 20, 24
SEG = ["s1", "s2"]


def anchors(buf: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor, gram hash) of all segments of some texts."""
    n, w = len(buf), length - GRAM + 1
    none = tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, U))
    if n < length:
        return none
    pre = B.prefix(buf)
    _, down = B.powers(n + 1)
    grams = (pre[GRAM:] - pre[:-GRAM]) * down[: n - GRAM + 1]
    key = (grams >> U(BITS) << U(BITS)) | np.arange(len(grams), dtype=U)
    full = -(-len(key) // w) * w
    blocks = np.full(full, np.iinfo(U).max, U)
    blocks[: len(key)] = key
    blocks = blocks.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    windows = n - length + 1
    at = (np.minimum(right[:windows], left[w - 1 : w - 1 + windows]) & U((1 << BITS) - 1)).astype(np.int64)
    inside = np.ones(windows, bool)
    for a in off[1:-1]:
        inside[max(0, a - length + 1) : min(a, windows)] = False
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (at[1:] != at[:-1])
    last = inside.copy()
    last[:-1] &= ~inside[1:] | (at[1:] != at[:-1])
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    return lo, hi, at[lo], grams[at[lo]]


def _digests(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    import xxhash

    data, digest = buf.tobytes(), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(data[a:b]) for a, b in zip(start.tolist(), end.tolist())]), np.int64).reshape(-1, 2)


def _slices(batch, length):
    """(row, rows, bytes, offsets, place of the first byte in its text)."""
    for row, n, buf, off in B.pieces(batch, "text", 2 << 20):
        for a in range(0, max(1, len(buf) - length + 1), SLICE if n == 1 else len(buf) + 1):
            b = min(len(buf), a + SLICE + length - 1) if n == 1 else len(buf)
            yield row, n, buf[a:b], off if n > 1 else np.array([0, b - a]), a


@B.tidied
def _anchor_rows(batches, length):
    import pyarrow as pa

    for batch in batches:
        for row, n, buf, off, a in _slices(batch, length):
            lo, hi, at, gram = anchors(buf, off, length)
            s = _digests(buf, lo, hi + length)
            own = B.owner(lo, off)
            base = off[own] - a
            keep = pa.array(own + row)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).take(keep) for i in range(3)], *map(pa.array, (lo - base, hi - base, at - base, gram.view(np.int64), s[:, 0], s[:, 1]))],
                ["doc_id", "_k1", "_k2", "lo", "hi", "at", "gram", "s1", "s2"],
            )


def _ranked(key: np.ndarray, bits: int) -> np.ndarray:
    """Dense ranks of keys of ``bits`` bits.  Where a place fits beside the key in 64
    bits, one plain sort of both does."""
    n = len(key)
    wide = max(1, int(n - 1).bit_length())
    if bits + wide > 64:
        return np.unique(key, return_inverse=True)[1].astype(U)
    both = np.sort(key << U(wide) | np.arange(n, dtype=U))
    place = (both & U((1 << wide) - 1)).astype(np.int64)
    both >>= U(wide)
    rank = np.empty(n, U)
    rank[place] = np.cumsum(np.append(False, both[1:] != both[:-1])).astype(U)
    return rank


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts in the order of their ``length`` bytes, and whether each shares all of
    them with the one before it.  Prefix doubling from 4 bytes."""
    n = len(data)
    if not len(starts):
        return starts, np.zeros(0, bool)
    padded = np.zeros(n + 4, np.uint8)
    padded[:n] = data
    word = np.zeros(n, U)
    for k in range(4):
        word = (word << U(8)) | padded[k : k + n].astype(U)
    rank, size, wide = _ranked(word, 32), 4, int(n + 1).bit_length()
    while 2 * size <= length:
        tail = np.zeros(n, U)
        tail[: n - size] = rank[size:] + U(1)
        rank, size = _ranked(rank << U(wide) | tail, 2 * wide), 2 * size
    key = rank[starts] << U(wide) | rank[np.minimum(starts + length - size, n - 1)]
    order = np.argsort(key)
    same = np.append(False, key[order[1:]] == key[order[:-1]])
    return starts[order], same


def smaller_before(sa: np.ndarray) -> np.ndarray:
    """For each place in ``sa`` the nearest place before it with a smaller value, or -1:
    pointers jump over larger values until all stand."""
    at = np.arange(len(sa)) - 1
    while True:
        move = np.flatnonzero(at >= 0)
        move = move[sa[at[move]] > sa[move]]
        if not len(move):
            return at
        at[move] = at[at[move]]


def has_previous_factor(sa: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Whether the longest previous factor of each suffix (in ``sa``'s order) has the
    full length: its previous or next smaller position lies in its run of equal ones."""
    run, back = np.cumsum(~same), len(sa) - 1
    before = smaller_before(sa)
    after = back - smaller_before(sa[::-1])[::-1]
    out = (before >= 0) & (run[before] == run)
    inside = after <= back
    out[inside] |= run[after[inside]] == run[inside]
    return out


def _with_equal_hashes(texts: list[bytes], length: int) -> np.ndarray:
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    if len(data) < length:
        return np.zeros(len(texts), bool)
    pre = B.prefix(data)
    _, down = B.powers(len(pre))
    window = (pre[length:] - pre[:-length]) * down[: len(data) - length + 1]
    own = np.repeat(np.arange(len(texts)), size)
    whole = np.flatnonzero(own[: len(window)] == own[length - 1 :])
    order = np.argsort(window[whole])
    ranked = window[whole[order]]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(texts), bool)
    out[own[whole[order[1:][same]]]] = out[own[whole[order[:-1][same]]]] = True
    return out


def repeated_windows(texts: list[bytes], length: int, keep: str) -> list[np.ndarray]:
    """For each text the windows to remove, as their first bytes; texts in the order of
    their place in the corpus."""
    if len(texts) > 1:
        # a text none of whose windows has the hash of another needs no sorting
        some = _with_equal_hashes(texts, length)
        if not some.all():
            inner = iter(repeated_windows([t for t, s in zip(texts, some) if s], length, keep) if some.any() else ())
            return [next(inner) if s else np.zeros(0, np.int64) for s in some]
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    base = np.cumsum(size) - size
    many = np.maximum(size - length + 1, 0)
    starts = np.repeat(base, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    sa, same = suffix_order(data, starts, length)
    out = has_previous_factor(sa, same)
    if keep == "none":
        out |= has_previous_factor(-sa, same)
    hit = np.sort(sa[out])
    cut = np.searchsorted(hit, np.append(base, len(data)))
    return [hit[a:b] - x for a, b, x in zip(cut[:-1], cut[1:], base)]


def merged(starts: np.ndarray, length: int) -> list[dict]:
    if not len(starts):
        return []
    new = np.append(True, np.diff(starts) > length)
    end = np.append(starts[np.flatnonzero(new)[1:] - 1], starts[-1]) + length
    return [{"start": a, "end": b} for a, b in zip(starts[new].tolist(), end.tolist())]


SPANS = "s1 long, s2 long, spans array<struct<start: long, end: long>>"


def _span_table(rows):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    cols = list(zip(*rows)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], kind)], ["s1", "s2", "spans"])


@B.tidied
def _suffix_groups(batches, length, keep, most=512 << 10):
    """Rows sorted by gram and place: whole grams are taken together until they hold
    ``most`` bytes."""

    def settle(rows):
        out = []
        seen, own = set(), []
        for r in rows:
            if (r["s1"], r["s2"]) not in seen:
                seen.add((r["s1"], r["s2"]))
                own.append(r)
        for r, hit in zip(own, repeated_windows([r["bytes"] for r in own], length, keep)):
            if len(hit):
                out.append((r["s1"], r["s2"], merged(hit, length)))
        return _span_table(out)

    rows, held, last = [], 0, None
    for batch in batches:
        for r in batch.to_pylist():
            if r["gram"] != last and held >= most:
                yield settle(rows)
                rows, held = [], 0
            rows.append(r)
            held, last = held + len(r["bytes"]), r["gram"]
    if rows:
        yield settle(rows)


@B.tidied
def _cut(batches, length):
    """Text and its wanted segments to rows with the segment's bytes."""
    import pyarrow as pa

    names = ["gram", "s1", "s2", "n", "many", "doc_id", "_k1", "_k2", "lo", "at"]
    for batch in batches:
        rows, data = [], []
        ids = batch.schema.get_field_index("doc_id")
        for text, doc, k1, k2, want in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "doc_id", "_k1", "_k2", "want"))):
            raw = (text or "").encode()
            for x in want:
                rows.append((x["gram"], x["s1"], x["s2"], x["n"], x["many"], doc, k1, k2, x["lo"], x["at"] - x["lo"]))
                data.append(raw[x["lo"] : x["hi"] + length])
        cols = list(zip(*rows)) or [[]] * len(names)
        kinds = [batch.schema.field(ids).type if c == "doc_id" else pa.int64() for c in names]
        yield pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(cols, kinds)], pa.array(data, pa.binary())], [*names, "bytes"])


@B.tidied
def _block_rows(batches, length, size):
    """Of each (segment, range of window places before the anchor) the blocks of
    ``size`` places: digest of what all windows of a block share, and of the whole."""
    import pyarrow as pa

    names = ["c1", "c2", "b1", "b2", "s1", "s2", "at", "low", "high", "n", "place"]
    for batch in batches:
        rows, core, clip = [], [], []
        for r in batch.to_pylist():
            raw, a = r["bytes"], r["at"]
            for x in range(r["low"] // size, r["high"] // size + 1):
                low, high = max(r["low"], x * size), min(r["high"], x * size + size - 1)
                head = b"%d %d " % (r["gram"], x)
                core.append(head + raw[a - x * size : a - (x * size + size - 1) + length])
                clip.append(head + b"%d %d " % (low, high) + raw[a - high : a - low + length])
                rows.append((r["s1"], r["s2"], a, low, high, r["n"], r["place"]))
        import xxhash

        d = [np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, x)), np.int64).reshape(-1, 2) for x in (core, clip)]
        cols = list(zip(*rows)) or [[]] * 7
        kind = batch.schema.field("place").type
        own = [pa.array(c, kind if i == 6 else pa.int64()) for i, c in enumerate(cols)]
        yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(x[:, j])) for x in d for j in (0, 1)], *own], names)


def _crowded(segments: DataFrame, length: int, keep: str) -> list[DataFrame]:
    """Spans of the segments of crowded grams; see 4."""
    place = F.struct("doc_id", *C.KEY, "lo")
    segments = C.stored(segments.withColumn("place", place), "crowded")
    ends = F.octet_length("bytes") - length
    work = segments.select(*SEG, (F.col("at") - ends).cast("long").alias("low"), F.col("at").alias("high"), "n")
    bytes_of = segments.select(*SEG, "gram", "at", "bytes", "place")
    out, size = [], -(-(length - GRAM + 1) // 7)
    kind = bytes_of.schema["place"].dataType.simpleString()
    while True:
        rows = work.join(bytes_of, SEG).mapInArrow(lambda it, s=size: _block_rows(it, length, s), f"c1 long, c2 long, b1 long, b2 long, s1 long, s2 long, at long, low long, high long, n long, place {kind}")
        rows = C.stored(rows, "blocks")
        clips = rows.groupBy("c1", "c2", "b1", "b2").agg(F.sum("n").alias("total"), F.min("place").alias("first"), F.min_by(F.struct(*SEG, "low", "high"), "place").alias("rep"))
        clips = C.stored(clips, "block-sums")
        twice = rows.join(clips.filter("total > 1").select("c1", "c2", "b1", "b2", "first"), ["c1", "c2", "b1", "b2"])
        if keep == "first":
            twice = twice.filter("place > first")
        out.append(twice.select(*SEG, F.array(F.struct((F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + length).alias("end"))).alias("spans")))
        if size == 1:
            return out
        # written first, as the shared grams are: a hot block's partition can be split
        cores = C.stored(clips.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("c1", "c2"), "open-blocks")
        work = clips.join(cores, ["c1", "c2"]).select("rep.s1", "rep.s2", "rep.low", "rep.high", F.col("total").alias("n"))
        size = -(-size // 7)


@B.tidied
def _apply(batches, at):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        kept, cuts, size = [], [], []
        for text, spans in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
            raw, runs = (text or "").encode(), []
            for s in sorted(spans or (), key=lambda s: s["start"]):
                if runs and s["start"] <= runs[-1]["end"]:
                    runs[-1]["end"] = max(runs[-1]["end"], s["end"])
                else:
                    runs.append(dict(s))
            edge = [0, *[x for r in runs for x in (r["start"], r["end"])], len(raw)]
            kept.append(b"".join(raw[a:b] for a, b in zip(edge[::2], edge[1::2])) if runs else raw)
            cuts.append(runs)
            size.append(len(raw))
        own = [pa.array(size, pa.int64()), pa.array([n - len(k) for n, k in zip(size, kept)], pa.int64()), pa.array([len(c) for c in cuts], pa.int64()), pa.array(cuts, kind), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *own], [*batch.schema.names[:-1], "n_bytes", "n_removed", "n_spans", "spans", "kept"])


@C.apart("n_bytes", "n_removed", "n_spans", "spans", "kept")
def remove_repeats(docs: DataFrame, length: int = 400, keep: str = "none", crowd: int = 512) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, spans (removed byte ranges) and kept
    (the remaining bytes).  ``length`` is at least 2 * 64."""
    if length < 2 * GRAM or keep not in ("none", "first"):
        raise ValueError("length is at least 128 and keep is none or first")
    spark = docs.sparkSession
    C.text_batches(spark)
    kind = dict(docs.dtypes)["doc_id"]
    keyed = C.with_row_key(docs, "doc_id", "text")
    rows = keyed.select("doc_id", *C.KEY, "text").mapInArrow(lambda it: _anchor_rows(it, length), f"doc_id {kind}, _k1 long, _k2 long, lo long, hi long, at long, gram long, s1 long, s2 long")
    rows = C.stored(rows, "anchors")
    # written first, so that both sides of the join are plain exchanges and a hot gram's
    # partition can be split
    again = C.stored(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("gram"), "shared-grams")
    rows = C.stored(rows.join(again, "gram"), "shared-anchors")
    place = F.struct("doc_id", *C.KEY, "lo")
    segments = C.stored(rows.groupBy("gram", *SEG).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.min_by(F.struct("hi", "at"), place).alias("ends")), "segments")
    several = C.stored(segments.groupBy("gram").agg(F.count(F.lit(1)).alias("many")).filter("many > 1"), "open-grams")
    open_ = segments.join(several, "gram").select("gram", *SEG, "n", "many", "first.*", "ends.*")
    wanted = open_.groupBy(*C.KEY).agg(F.collect_list(F.struct("gram", *SEG, "n", "many", "lo", "hi", "at")).alias("want"))
    texts = keyed.select("doc_id", *C.KEY, "text").join(wanted, C.KEY).select("doc_id", *C.KEY, "text", "want")
    cut = C.stored(texts.mapInArrow(lambda it: _cut(it, length), f"gram long, s1 long, s2 long, n long, many long, doc_id {kind}, _k1 long, _k2 long, lo long, at long, bytes binary"), "segment-bytes")

    few = cut.filter(F.col("many") <= crowd).repartition(C.partitions(spark), "gram").sortWithinPartitions("gram", "doc_id", *C.KEY, "lo")
    spans = [few.select("gram", *SEG, "bytes").mapInArrow(lambda it: _suffix_groups(it, length, keep), SPANS)]
    crowded = cut.filter(F.col("many") > crowd).dropDuplicates(SEG)
    if not crowded.isEmpty():
        spans += _crowded(crowded, length, keep)
    found = C.stored(spans[0] if len(spans) == 1 else _union(spans), "repeat-spans").groupBy(*SEG).agg(F.flatten(F.collect_list("spans")).alias("spans"))

    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), (F.col("hi") - F.col("lo") + length).alias("end")))
    per = segments.join(found, SEG, "left").select(*SEG, "n", "first", "spans").filter("n > 1 OR spans IS NOT NULL")
    per = C.stored(per, "segment-spans")
    hits = rows.join(per, SEG)
    mine = place == F.col("first")
    whole_hit = (F.col("n") > 1) if keep == "none" else ~mine
    hits = hits.select(*C.KEY, "lo", F.explode(F.when(whole_hit, whole).otherwise(F.col("spans"))).alias("s"))
    hits = hits.groupBy(*C.KEY).agg(F.collect_set(F.struct((F.col("s.start") + F.col("lo")).alias("start"), (F.col("s.end") + F.col("lo")).alias("end"))).alias("_spans"))
    joined = keyed.join(hits, C.KEY, "left").select(*docs.columns, "_spans")
    more = "n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept binary"
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(more).fields])
    at = docs.columns.index("text")
    return joined.mapInArrow(lambda it: _apply(it, at), schema)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
