"""Operator 4: shards of near equal bytes by longest-processing-time scheduling.

Groups that must stay together (here: equal texts) are sorted by size, largest
first, and each goes to the least-loaded shard, taken from a heap.  The scheduler
sees size classes, not groups: every size up to 64 KiB is a class of its own, larger
sizes share a class where their leading 12 bits agree, so it gets at most some
100,000 rows however many groups there are.  Equal sizes go out as the heap would
send them one by one, counted in bulk.  Which group of a class is which comes from a
distributed rank.

A class of large sizes is planned with its mean, which is off by less than one part in
2 ** 11 for each of its groups, so no shard's load is off by more than that part of the
bytes in such classes (``tests/llm`` holds it).

Cases: a null text is an empty one; texts of any length are measured whole; extra columns
do not matter; null or repeated doc_ids keep their rows; equal
texts share a shard; ties go to the lower shard; empty tables give empty results.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

EXACT, LEADING = 1 << 16, 12
#: Rows of a plan (some 60 bytes each, so 60 MB at most) that are broadcast.
MOST_SENT = 1_000_000


def lpt(classes: list[tuple[int, float, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """(class, size of each, how many), largest first, to (class, first rank, last
    rank + 1, shard)."""
    heap = [(0.0, s) for s in range(shards)]
    out = []
    for name, size, n in classes:
        if n <= 4 * shards:
            took = [0] * shards
            for _ in range(n):
                load, s = heapq.heappop(heap)
                took[s] += 1
                heapq.heappush(heap, (load + size, s))
        else:
            took = _level(sorted(heap, key=lambda x: x[1]), size, n)
            heap = [(load + size * took[s], s) for load, s in heap]
            heapq.heapify(heap)
        at = 0
        for s, k in enumerate(took):
            if k:
                out.append((name, at, at + k, s))
                at += k
    return out


def _level(loads: list[tuple[float, int]], size: float, n: int) -> list[int]:
    """How many of n equal items each shard gets if they go one by one to the least
    loaded: the n smallest of load, load + size, load + 2 size, ... of all shards."""
    low, high = 0.0, max(x for x, _ in loads) + size * (n + 1)
    count = lambda level, load: max(0, int((level - load) // size) + (load <= level))
    for _ in range(200):
        mid = (low + high) / 2
        if sum(count(mid, x) for x, _ in loads) >= n:
            high = mid
        else:
            low = mid
    took = [count(low, x) for x, _ in loads]
    rest = [(x + size * k, s) for (x, s), k in zip(loads, took)]
    heapq.heapify(rest)
    for _ in range(n - sum(took)):
        load, s = heapq.heappop(rest)
        took[s] += 1
        heapq.heappush(rest, (load + size, s))
    return took


def size_class(size):
    """The size itself up to EXACT, else the size with all but its leading bits zero."""
    drop = F.greatest(F.length(F.bin(size)) - LEADING, F.lit(0))
    return F.when(size <= EXACT, size).otherwise(F.call_function("shiftleft", F.call_function("shiftright", size, drop), drop))


def shard_by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for each document."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(F.lit(3), text).alias("_t1"), F.xxhash64(F.lit(5), text).alias("_t2"))
    rows = C.stored(rows, "shard-rows")
    groups = rows.groupBy("_t1", "_t2").agg(F.sum("size").alias("_bytes"))
    groups = C.ranked(groups.select("_t1", "_t2", "_bytes", size_class(F.col("_bytes")).cast("long").alias("_class")), "_class", ["_t1", "_t2"])
    classes = groups.groupBy("_class").agg(F.avg("_bytes").alias("s"), F.count(F.lit(1)).alias("n")).toPandas().sort_values("_class", ascending=False)
    plan = lpt([(int(a), float(b), int(c)) for a, b, c in classes.itertuples(index=False)], shards)
    table = spark.createDataFrame(plan, "_c long, _from long, _to long, shard int")
    # a plan of checked size goes to all, so that a popular size is no hot key
    table = F.broadcast(table) if len(plan) <= MOST_SENT else table
    placed = groups.join(table, (F.col("_class") == F.col("_c")) & (F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_to"))).select("_t1", "_t2", "shard")
    out = C.ranked(rows.join(placed, ["_t1", "_t2"]), "shard", ["_t1", "_t2", "doc_id"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
