"""Operator 10: as few sequences as possible, by dominance reduction and best fit.

Documents become token ids; only longer ones than a sequence are cut, into full
pieces after a shorter first one.  What the planner needs of them is how many pieces
there are of each length, at most ``capacity`` rows.  On these counts it first fixes,
for good, small sets that dominate every other set with their largest piece (the
reduction of Martello and Toth):

* a piece that nothing fits beside stands alone;
* two pieces that fill a sequence exactly go together;
* if at most one piece fits beside a piece, the largest that fits joins it;
* if at most two fit, the largest single one joins it when no pair that fits is
  larger in sum.

The rest is packed best-fit, largest first.  All steps move many pieces of a length
at once.  The plan names ranks within a length; ranks come from a distributed sort.

Cases: a null text is an empty one (its end id only); repeated rows and equal
lengths are ordinary; texts of any length are cut up; ties in rank follow doc_id and
piece; doc_ids may be of any type; an empty table gives an empty result; extra columns
do not matter.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .bytesops import pieces as byte_pieces, tidied
from .encoding import ByteEncoder, held

BIG = 1 << 40
PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *[(at, capacity) for at in range(first, n, capacity)]]


@tidied
def _pieces(batches, path, end, capacity):
    import pyarrow as pa

    encoder = held(ByteEncoder, path)
    for batch in batches:
        for first, n, _, _ in byte_pieces(batch, "text", 1 << 20):
            ids = encoder.encode([t or "" for t in batch.column(1).slice(first, n).to_pylist()])
            rows = []
            for doc, x in zip(batch.column(0).slice(first, n).to_pylist(), ids):
                x = np.append(x, np.uint32(end)).astype("<u4")
                rows += [(doc, i, at, size, zlib.crc32(x[at : at + size])) for i, (at, size) in enumerate(cut(len(x), capacity))]
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])


def plan_packing(counts: np.ndarray, capacity: int) -> np.ndarray:
    """counts[s]: pieces of length s.  Rows (length, first rank, pieces, pieces for
    each sequence, first sequence, offset), sorted by length and rank."""
    left, used, out = counts.astype(np.int64).copy(), np.zeros(capacity + 1, np.int64), []
    sequences = 0

    def put(size, n, sequence, offset, each=1):
        out.append((size, used[size], n, each, sequence, offset))
        used[size] += n
        left[size] -= n

    for size in range(capacity, 0, -1):
        while left[size]:
            room = capacity - size
            left[size] -= 1
            there = np.flatnonzero(left)
            left[size] += 1
            few = np.repeat(there[:3], np.minimum(left[there[:3]] - (there[:3] == size), 3))[:3] if len(there) else there
            fits = there[there <= room]
            if not len(fits):
                n = left[size]
                put(size, n, sequences, 0)
            else:
                other = int(fits[-1])
                sums = [int(few[:k].sum()) for k in (2, 3)]
                single = other == room or len(few) < 2 or sums[0] > room
                if not single and (len(few) < 3 or sums[1] > room):
                    single = other >= _best_pair(fits, left, size, room)
                if not single:
                    break
                n = min(left[size], left[other]) if other != size else left[size] // 2
                put(size, n, sequences, 0)
                put(other, n, sequences, size)
            sequences += n

    bins: dict[int, list[tuple[int, int]]] = {}
    for size in range(capacity, 0, -1):
        n = int(left[size])
        for room in sorted(r for r in bins if r >= size and bins[r]) if n else ():
            each, held_ = room // size, bins.pop(room)
            while n and held_:
                first, m = held_.pop()
                full = min(m, n // each)
                if full:
                    put(size, full * each, first, capacity - room, each)
                    bins.setdefault(room - each * size, []).append((first, full))
                    n -= full * each
                if n and full < m:
                    put(size, n, first + full, capacity - room, n)
                    bins.setdefault(room - n * size, []).append((first + full, 1))
                    n, full = 0, full + 1
                if full < m:
                    held_.append((first + full, m - full))
            if held_:
                bins.setdefault(room, []).extend(held_)
        each = capacity // size
        for k, m in ((each, n // each), (n % each, 1 if n % each else 0)):
            if m:
                put(size, k * m, sequences, 0, k)
                bins.setdefault(capacity - k * size, []).append((sequences, m))
                sequences += m
    return np.array(sorted(out), np.int64).reshape(-1, 6)


def _best_pair(fits: np.ndarray, left: np.ndarray, own: int, room: int) -> int:
    """The largest sum of two pieces, besides one of length ``own``, that fits."""
    best, i, j = 0, 0, len(fits) - 1
    while i <= j:
        total = int(fits[i] + fits[j])
        if total > room:
            j -= 1
            continue
        if i < j or left[fits[i]] - (fits[i] == own) >= 2:
            best = max(best, total)
        i += 1
    return best


@tidied
def _place(batches, plan):
    import pyarrow as pa

    keys = plan.value[:, 0] * BIG + plan.value[:, 1]
    for batch in batches:
        size, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
        row = plan.value[np.searchsorted(keys, size * BIG + rank, "right") - 1]
        nth = rank - row[:, 1]
        own = batch.columns[:-1]
        yield pa.RecordBatch.from_arrays([*own, pa.array(row[:, 4] + nth // row[:, 3]), pa.array(row[:, 5] + nth % row[:, 3] * size)], [*batch.schema.names[:-1], "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    ``tokenizer``: the vocabulary file of a byte-level vocabulary."""
    spark, kind = docs.sparkSession, PIECES.format(id=dict(docs.dtypes)["doc_id"])
    C.text_batches(docs.sparkSession)
    cut_up = C.stored(docs.select("doc_id", "text").mapInArrow(lambda it: _pieces(it, tokenizer, end, capacity), kind), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in cut_up.groupBy("length").count().collect():
        counts[size] = n
    plan = spark.sparkContext.broadcast(plan_packing(counts, capacity))
    rows = C.ranked(cut_up, "length", ["doc_id", "piece", "start", "ids_crc32"]).select(*cut_up.columns, "rank")
    return rows.mapInArrow(lambda it: _place(it, plan), kind + ", sequence_id long, offset long")
