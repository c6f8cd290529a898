"""Operator 5: benchmark decontamination by a distributed positional inverted index.

The training side is stored as index segments, each of a few MB of whole documents:
terms (64-bit hashes of lower-cased words), and for each term its ascending positions.
Positions run through a segment with a gap between documents, so no match crosses a
border.  A query (window of consecutive benchmark words) starts from the posting list
that is shortest in the segment, shifts it by the word's offset, and is intersected
with the other words' shifted lists, the next rarest first.  What is left are exact
phrase matches.  ``slop`` adds proximity matches: places where every word of a window
stands within ``len(window) - 1 + slop`` words of an occurrence of its rarest one.

Benchmark items come in blocks of at most ``block_words`` words, which is what is
broadcast at a time.  With one block the index keeps the terms of the benchmark only.

Cases: a null text has no words; items without words match nothing, items shorter
than a window are one window; rows with the same item_id are one item, and what an item
without an id has counts as hit words only; among equally rare words any may come first,
with the same matches; repeated documents are each searched; texts of any length are
taken whole, long ones as a segment of their own; empty tables give no hits; columns
with the names of the results are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from . import common as C

U = np.uint64
SEGMENT = "segment long, doc_id array<{id}>, k1 array<long>, k2 array<long>, base array<long>, n_words array<long>, terms array<long>, term_from array<long>, positions array<long>"
FOUND = "doc_id {id}, _k1 long, _k2 long, n_words long, spans array<struct<start: long, end: long>>, items array<string>, near_items array<string>, _segment long, _nth long"


def words_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the first word of each text."""
    buf = B.TO_LOWER[buf]
    starts, ends = B.spans(B.WORDISH[buf], off)
    return B.span_hash(B.prefix(buf), starts, ends), np.searchsorted(starts, off)


@B.tidied
def _segments(batches, vocabulary, gap):
    import pyarrow as pa

    known = vocabulary.value if vocabulary is not None else None
    pid, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        for row, n, buf, off in B.pieces(batch):
            word, first = words_of(buf, off)
            own = np.repeat(np.arange(n), np.diff(first))
            at = np.arange(len(word)) + gap * own
            if known is not None:
                i = np.searchsorted(known, word)
                has = np.zeros(len(word), bool)
                has[i < len(known)] = known[i[i < len(known)]] == word[i < len(known)]
                word, at = word[has], at[has]
            order = np.argsort(word, kind="stable")
            word, at = word[order], at[order]
            new = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
            one = lambda x: B.list_column(x, [len(x)], pa.int64())
            ids = batch.column(0).slice(row, n)
            ids = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids)
            k1, k2 = (one(batch.column(k).slice(row, n).to_numpy()) for k in (1, 2))
            cols = [pa.array([(pid << 32) + seq]), ids, k1, k2, one(first[:-1] + gap * np.arange(n)), one(np.diff(first)), one(word[new].view(np.int64)), one(np.append(new, len(word))), one(at)]
            yield pa.RecordBatch.from_arrays(cols, ["segment", "doc_id", "k1", "k2", "base", "n_words", "terms", "term_from", "positions"])
            seq += 1


def _phrases(postings, lists, windows, lens, slop):
    """(window, start) of all phrase matches, and windows and places of proximity.
    postings: sorted term << 40 | position; lists: where each term's begin."""
    width = windows.shape[1]
    size = np.diff(lists)
    real = np.arange(width)[None, :] < lens[:, None]
    count = np.where(real, size[np.where(real, windows, 0)], np.iinfo(np.int64).max)
    live = np.flatnonzero((count > 0).all(axis=1))
    order = np.argsort(count[live], axis=1, kind="stable")
    term = np.take_along_axis(windows[live], order, axis=1)
    rare = size[term[:, 0]] if len(live) else np.zeros(0, np.int64)
    win = np.repeat(np.arange(len(live)), rare)
    nth = np.arange(len(win)) - np.repeat(np.cumsum(rare) - rare, rare)
    place = (postings[lists[term[win, 0]] + nth] & ((1 << 40) - 1)).astype(np.int64)
    start = place - order[win, 0]
    keep = np.arange(len(win))
    for j in range(1, width):
        more = lens[live][win[keep]] > j
        k = keep[more]
        want = (term[win[k], j].astype(np.int64) << 40) + start[k] + order[win[k], j]
        i = np.searchsorted(postings, want)
        ok = np.zeros(len(k), bool)
        ok[i < len(postings)] = postings[i[i < len(postings)]] == want[i < len(postings)]
        keep = np.concatenate([keep[~more], k[ok & (start[k] >= 0)]])
    near = None
    if slop is not None:
        stay = np.arange(len(win))
        for j in range(1, width):
            more = lens[live][win[stay]] > j
            k = stay[more]
            span = lens[live][win[k]] - 1 + slop
            base = term[win[k], j].astype(np.int64) << 40
            low = np.searchsorted(postings, base + np.maximum(place[k] - span, 0))
            high = np.searchsorted(postings, base + place[k] + span, "right")
            stay = np.concatenate([stay[~more], k[high > low]])
        near = live[win[stay]], place[stay]
    return live[win[keep]], start[keep], near


@B.tidied
def _search(batches, queries, slop):
    import pyarrow as pa

    vocabulary, windows, lens, hosts, names = queries.value
    for batch in batches:
        for r in range(batch.num_rows):
            cell = lambda c: batch.column(batch.schema.get_field_index(c))[r].values  # noqa: E731,B023
            base, n_words, terms, begin, positions = (cell(c).to_numpy() for c in ("base", "n_words", "terms", "term_from", "positions"))
            # this segment's lists of the benchmark's terms, in their order
            i = np.minimum(np.searchsorted(terms.view(U), vocabulary), max(len(terms) - 1, 0))
            has = terms.view(U)[i] == vocabulary if len(terms) else np.zeros(len(vocabulary), bool)
            size = np.where(has, begin[i + 1] - begin[i], 0) if len(terms) else np.zeros(len(vocabulary), np.int64)
            lists = np.append(0, np.cumsum(size))
            source = np.repeat(begin[i] if len(terms) else lists[:-1], size) + np.arange(lists[-1]) - np.repeat(lists[:-1], size)
            postings = (np.repeat(np.arange(len(vocabulary)), size) << 40) + positions[source]
            window, start, near = _phrases(postings, lists, windows, lens, slop)
            docs = len(base)
            spans, items, close = [[] for _ in range(docs)], [set() for _ in range(docs)], [set() for _ in range(docs)]
            if len(window):
                cover = np.zeros(int(base[-1] + n_words[-1]) + windows.shape[1] + 2, np.int64)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + lens[window], -1)
                cover = np.append(np.cumsum(cover) > 0, False)
                a = np.flatnonzero(cover[1:] & ~cover[:-1]) + 1
                a = np.append(0, a) if cover[0] else a
                b = np.flatnonzero(cover[:-1] & ~cover[1:]) + 1
                host = np.searchsorted(base, a, "right") - 1
                for d, x, y in zip(host.tolist(), (a - base[host]).tolist(), (b - base[host]).tolist()):
                    spans[d].append({"start": x, "end": y})
            for found, into in ((None if not len(window) else (window, start), items), (near, close)):
                if found is not None and len(found[0]):
                    # of documents without words, which share a base, the last comes up: it has no match
                    pair = np.unique(np.stack([np.searchsorted(base, found[1], "right") - 1, found[0]]), axis=1)
                    for d, w in pair.T.tolist():
                        into[d].update(hosts[w])
            text = lambda sets: pa.array([sorted(names[i] for i in s) for s in sets], pa.list_(pa.string()))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([cell("doc_id"), cell("k1"), cell("k2"), pa.array(n_words), pa.array(spans, kind), text(items), text(close), pa.array([batch.column(0)[r].as_py()] * docs, pa.int64()), pa.array(range(docs), pa.int64())], ["doc_id", "_k1", "_k2", "n_words", "spans", "items", "near_items", "_segment", "_nth"])


def _blocks(benchmark: DataFrame, window: int, most: int):
    """Query blocks: (terms, windows as term numbers, their lengths, items of each window, item names)."""
    import pyarrow as pa

    def block(rows):
        names = sorted({str(r[0]) for r in rows if r[0] is not None})
        number = {n: i for i, n in enumerate(names)}
        batch = pa.RecordBatch.from_arrays([pa.array([r[1] or "" for r in rows], pa.string())], ["text"])
        buf, off = B.text_column(batch)
        word, first = words_of(buf, off)
        vocabulary, at = np.unique(word, return_inverse=True)
        hosts: dict[tuple, set] = {}
        for k, r in enumerate(rows):
            own = at[first[k] : first[k + 1]].tolist()
            for i in range(max(1, len(own) - window + 1) if own else 0):
                hosts.setdefault(tuple(own[i : i + window]), set()).update([] if r[0] is None else [number[str(r[0])]])
        grid = np.full((len(hosts), window), -1, np.int64)
        for i, w in enumerate(hosts):
            grid[i, : len(w)] = w
        return vocabulary, grid, (grid >= 0).sum(axis=1), list(hosts.values()), names

    rows, held = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        rows.append(r)
        held += len(r[1] or "") // 2 + 1
        if held >= most:
            yield block(rows)
            rows, held = [], 0
    if rows:
        yield block(rows)


def _merged(spans: list) -> list:
    out: list = []
    for s in sorted(spans, key=lambda s: s["start"]):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append({"start": s["start"], "end": s["end"]})
    return out


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int | None = None, block_words: int = 2_000_000) -> DataFrame:
    """One row for each document: doc_id, row keys, n_words, spans (word positions
    covered by matches), items (ids as strings, sorted), near_items."""
    spark = docs.sparkSession
    C.text_batches(spark)
    kind = dict(docs.dtypes)["doc_id"]
    keyed = C.with_row_key(docs.select("doc_id", "text"), "doc_id", "text").select("doc_id", *C.KEY, "text")
    blocks = _blocks(benchmark, window, block_words)
    first, second = next(blocks, None), next(blocks, None)
    vocabulary = spark.sparkContext.broadcast(first[0] if first else np.zeros(0, U)) if second is None else None
    gap = 2 * window + (slop or 0)
    segments = keyed.mapInArrow(lambda it: _segments(it, vocabulary, gap), SEGMENT.format(id=kind))
    index = C.stored(segments, "positional-index")

    def search(block):
        queries = spark.sparkContext.broadcast(block)
        return index.mapInArrow(lambda it: _search(it, queries, slop), FOUND.format(id=kind))

    empty = np.zeros(0, U), np.zeros((0, window), np.int64), np.zeros(0, np.int64), [], []
    found = C.stored(search(first or empty), "benchmark-hits")
    if second is None:
        return found
    merge, rest = F.udf(_merged, "array<struct<start: long, end: long>>"), [second]
    while rest:
        # a block at a time: its hits join those of the blocks before
        both = found.unionByName(C.stored(search(rest.pop()), "benchmark-hits"))
        one = both.groupBy("doc_id", *C.KEY, "n_words", "_segment", "_nth").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "near_items")])
        sets = [F.array_sort(F.array_distinct(c)).alias(c) for c in ("items", "near_items")]
        found = C.stored(one.select("doc_id", *C.KEY, "n_words", merge("spans").alias("spans"), *sets, "_segment", "_nth"), "benchmark-hits")
        more = next(blocks, None)
        rest = [more] if more else []
    return found


@C.apart()
def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` less the rows in which a benchmark window occurs."""
    hit = benchmark_hits(docs, benchmark, window).filter("size(spans) > 0").select(*C.KEY).distinct()
    return C.with_row_key(docs, "doc_id", "text").join(hit, C.KEY, "left_anti").select(*docs.columns)
