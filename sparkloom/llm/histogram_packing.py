"""Operator 13: sequences with little padding, by shortest-pack-first over the histogram
of lengths.

Documents become token ids; longer ones than a sequence are cut into full pieces and a
rest.  Only how many pieces there are of each length (at most ``capacity`` numbers) goes to
the driver.  Lengths are placed longest first, each into the packs that are shortest so far,
or into new ones when it fits in none; packs are kept as patterns (total, how many), and many
equal pieces go to many equal packs at once.

As documents may be cut freely, what the packing leaves unfilled is then filled exactly: with
N ids, the N // capacity fullest packs stay, and the documents of all shorter packs, one after
another, are poured into their gaps.  What is left of them after the last gap goes into
sequences whose lengths are the powers of two that sum to it, which need no padding, so there
is none at all.  A poured document is cut only where a gap ends.

The patterns name ranks within a length.  Ranks need no sort: each task that encodes numbers
its pieces of a length, and the tasks' counts, summed over earlier tasks, are where each starts.

Cases: a null text is an empty one (its end id only); repeated rows and equal lengths are
ordinary, ties in rank follow where rows lie; texts of any length are cut up; doc_ids may be
null, repeated and of any type; an empty table gives an empty result; extra columns do not
matter.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .bytesops import pieces as byte_pieces, tidied
from .encoding import WordEncoder, held

BIG = 1 << 40
PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long"


@tidied
def _pieces(batches, path, end, capacity):
    import pyarrow as pa

    encoder, task, row, met = held(WordEncoder, path), TaskContext.get().partitionId(), 0, np.zeros(capacity + 1, np.int64)
    kinds = (None, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "row", "nth", "ids"]
    for batch in batches:
        for first, n, _, _ in byte_pieces(batch, "text", 1 << 20):
            ids = encoder.encode([t or "" for t in batch.column(1).slice(first, n).to_pylist()])
            rows = []
            for doc, x in zip(batch.column(0).slice(first, n).to_pylist(), ids):
                x = np.append(x, np.uint32(end)).astype("<u4")
                for at in range(0, len(x), capacity):
                    part = x[at : at + capacity]
                    # two bytes for each id where all fit, which the lengths tell apart
                    kept = part.astype("<u2") if part.max() < 1 << 16 else part
                    rows.append((doc, at, len(part), zlib.crc32(part), len(x), task, row, int(met[len(part)]), kept.tobytes()))
                    met[len(part)] += 1
                    row += 1
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, t or batch.schema.field(0).type) for c, t in zip(cols, kinds)], names)


def plan_patterns(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """counts[s]: pieces of length s.  Rows (length, first rank, pieces, pieces for each
    pack, first pack, offset), sorted by length and rank; and the packs: rows (total, first
    pack, packs)."""
    packs: list[tuple[int, int, int]] = []
    out, made = [], 0
    for size in range(capacity, 0, -1):
        left, used = int(counts[size]), 0
        while left:
            if packs and packs[0][0] + size <= capacity:
                total, first, n = heapq.heappop(packs)
                # as many each as it takes to pass the next shortest
                beyond = packs[0][0] if packs else capacity
                each = min(max(1, -((total - beyond) // size)), (capacity - total) // size)
                if left < n * each:
                    each = max(1, left // n)
                    if (m := min(n, left // each)) < n:
                        heapq.heappush(packs, (total, first + m, n - m))
                        n = m
            else:
                total, each, first = 0, min(capacity // size, left), made
                n = left // each
                made += n
            out.append((size, used, n * each, each, first, total))
            heapq.heappush(packs, (total + each * size, first, n))
            used += n * each
            left -= n * each
    return np.array(sorted(out), np.int64).reshape(-1, 6), np.array(sorted(packs), np.int64).reshape(-1, 3)


def plan_pouring(packs: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The packs that are poured out: rows (first pack, packs, total, where in the stream
    of poured ids the first one starts), sorted by pack; and where the stream goes: rows
    (where in the stream, first sequence, sequences, offset in each, ids for each)."""
    made = int(packs[:, 2].sum()) if len(packs) else 0
    ids = int((packs[:, 0] * packs[:, 2]).sum()) if len(packs) else 0
    stay, source, sink, at, to = ids // capacity, [], [], 0, 0
    for total, first, n in packs[::-1].tolist():
        kept = min(n, stay)
        stay -= kept
        if kept and total < capacity:
            sink.append((to, first, kept, total, capacity - total))
            to += kept * (capacity - total)
        if n > kept:
            source.append((first + kept, n - kept, total, at))
            at += (n - kept) * total
    for bit in range(capacity.bit_length() - 1, -1, -1):
        if (at - to) & 1 << bit:
            sink.append((to, made, 1, 0, 1 << bit))
            to, made = to + (1 << bit), made + 1
    return np.array(sorted(source), np.int64).reshape(-1, 4), np.array(sink, np.int64).reshape(-1, 5)


@tidied
def _place(batches, plan):
    """Each piece's pack and offset, or, where its pack is poured out, its place in the stream."""
    import pyarrow as pa

    patterns, source = plan.value[:2]
    keys = patterns[:, 0] * BIG + patterns[:, 1]
    for batch in batches:
        size, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
        row = patterns[np.searchsorted(keys, size * BIG + rank, "right") - 1]
        nth = rank - row[:, 1]
        pack, offset = row[:, 4] + nth // row[:, 3], row[:, 5] + nth % row[:, 3] * size
        poured = np.full(len(pack), -1)
        if len(source) and len(pack):
            by = source[np.maximum(np.searchsorted(source[:, 0], pack, "right") - 1, 0)]
            inside = (pack >= by[:, 0]) & (pack < by[:, 0] + by[:, 1])
            poured[inside] = (by[:, 3] + (pack - by[:, 0]) * by[:, 2] + offset)[inside]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pack), pa.array(offset), pa.array(poured)], [*batch.schema.names[:-1], "sequence_id", "offset", "poured"])


@tidied
def _pour(batches, plan):
    """Poured pieces, cut where a gap ends."""
    import pyarrow as pa

    sink = plan.value[2]
    kinds = (None, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    for batch in batches:
        rows = []
        for doc, start, length, tokens, at, ids in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "start", "length", "doc_tokens", "poured", "ids")]):
            x = np.frombuffer(ids, "<u2" if len(ids) == 2 * length else "<u4").astype("<u4")
            done, way = 0, int(np.searchsorted(sink[:, 0], at, "right")) - 1
            while done < length:
                to, first, n, offset, each = sink[way].tolist()
                nth, over = divmod(at + done - to, each)
                if nth >= n:
                    way += 1
                    continue
                took = min(each - over, length - done)
                rows.append((doc, start + done, took, zlib.crc32(x[done : done + took]), tokens, first + nth, offset + over))
                done += took
        cols = list(zip(*rows)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t or batch.schema.field(0).type) for c, t in zip(cols, kinds)], names)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 2) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    ``tokenizer``: the file of a vocabulary of lower-case words with word ends."""
    spark, kind = docs.sparkSession, PIECES.format(id=dict(docs.dtypes)["doc_id"])
    C.text_batches(spark)
    cut_up = docs.select("doc_id", "text").mapInArrow(lambda it: _pieces(it, tokenizer, end, capacity), kind + ", task int, row long, nth long, ids binary")
    cut_up = C.stored(cut_up, "histogram-pieces")
    held_ = cut_up.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    held_ = C.stored(held_.select("task", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "histogram")
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in held_.groupBy("length").agg(F.sum("n")).collect():
        counts[size] = n
    patterns, packs = plan_patterns(counts, capacity)
    plan = spark.sparkContext.broadcast((patterns, *plan_pouring(packs, capacity)))
    narrow = [f.name for f in cut_up.schema.fields if f.name not in ("nth", "ids")]
    rows = cut_up.drop("ids").join(held_.drop("n"), ["task", "length"]).select(*narrow, (F.col("first") + F.col("nth")).alias("rank"))
    placed = C.stored(rows.mapInArrow(lambda it: _place(it, plan), kind + ", task int, row long, sequence_id long, offset long, poured long"), "histogram-placed")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    poured = placed.filter("poured >= 0").join(cut_up.select("task", "row", "ids"), ["task", "row"])
    poured = poured.select("doc_id", "start", "length", "doc_tokens", "poured", "ids").mapInArrow(lambda it: _pour(it, plan), kind + ", sequence_id long, offset long")
    return placed.filter("poured < 0").select(*names).unionByName(poured.select(*names))
