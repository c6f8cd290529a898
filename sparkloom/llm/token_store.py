"""Operator 9: token ids in a binary format of bit or byte planes.

Documents are encoded in ascending doc_id order and laid end to end.  A block of a
fixed number of ids is transposed into planes (plane p of bytes: byte p of every id;
of bits: bit p of every id), and each plane is compressed with zstandard.  A block
starts with a header: magic, version, kind of plane, number of ids, number of planes,
and the compressed length of each plane.  The chunk index of a block holds its shard,
number, first id and ids, and which documents have ids in it.

Blocks and index are written by Spark as rows of a table, as its writers reach any
store and commit whole tasks only.  read_documents() works from that table alone,
block by block, with no join.

Cases: a null text is an empty one (its end id only); null doc_ids come first; equal
doc_ids follow each other in an order fixed by their texts; documents of any length
span blocks, and each id is copied once whatever the length; doc_ids may be of any
type; an empty table gives an empty store; extra columns do not matter.
"""

from __future__ import annotations

import struct
import zlib
from collections import deque

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .bytesops import pieces, tidied
from .encoding import ByteEncoder, held

MAGIC, BLOCK = b"IDPL", 1 << 16
STORE = "shard int, chunk int, first long, n_ids long, block binary, docs array<struct<doc_id: {id}, at: long, n_tokens: long>>"


def pack_block(ids: np.ndarray, planes: str = "byte", level: int = 3) -> bytes:
    import zstandard

    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    rows = raw.T if planes == "byte" else np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
    squeeze = zstandard.ZstdCompressor(level=level)
    parts = [squeeze.compress(np.ascontiguousarray(r).tobytes()) for r in rows]
    head = struct.pack("<4sBBIH", MAGIC, 1, planes == "bit", len(ids), len(parts))
    return head + struct.pack(f"<{len(parts)}I", *map(len, parts)) + b"".join(parts)


def unpack_block(block: bytes) -> np.ndarray:
    import zstandard

    magic, version, bits, n, count = struct.unpack_from("<4sBBIH", block)
    if magic != MAGIC or version != 1:
        raise ValueError("not a block of token ids")
    at = struct.calcsize("<4sBBIH")
    sizes = struct.unpack_from(f"<{count}I", block, at)
    at += 4 * count
    loose, rows = zstandard.ZstdDecompressor(), []
    for size in sizes:
        rows.append(np.frombuffer(loose.decompress(block[at : at + size]), np.uint8))
        at += size
    grid = np.stack(rows)
    if bits:
        grid = np.packbits(np.unpackbits(grid, axis=1, bitorder="little")[:, :n].T, axis=1, bitorder="little")
        return np.ascontiguousarray(grid).view("<u4").reshape(-1)
    return np.ascontiguousarray(grid.T).view("<u4").reshape(-1)


@tidied
def _blocks(batches, path, end, planes, size):
    import pyarrow as pa

    encoder, shard = held(ByteEncoder, path), TaskContext.get().partitionId()
    waiting, many, total, chunk, docs, schema = deque(), 0, 0, 0, deque(), None

    def flush(n):
        """The first ``n`` of the waiting ids, as a block; each id is copied once."""
        nonlocal many, chunk
        first, parts, need = total - many, [], n
        while need:
            part = waiting.popleft()
            if len(part) > need:
                waiting.appendleft(part[need:])
                part = part[:need]
            parts.append(part)
            need -= len(part)
        own = []
        while docs and docs[0]["at"] < first + n:
            own.append(docs[0])
            if docs[0]["at"] + docs[0]["n_tokens"] > first + n:
                break
            docs.popleft()
        row = {"shard": shard, "chunk": chunk, "first": first, "n_ids": n, "block": pack_block(np.concatenate(parts), planes), "docs": own}
        many, chunk = many - n, chunk + 1
        return pa.RecordBatch.from_pylist([row], schema)

    for batch in batches:
        schema = schema or pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("block", pa.binary()), ("docs", pa.list_(pa.struct([("doc_id", batch.schema.field(0).type), ("at", pa.int64()), ("n_tokens", pa.int64())])))])
        for first, n, _, _ in pieces(batch, "text", 1 << 20):
            texts = [t or "" for t in batch.column(1).slice(first, n).to_pylist()]
            for doc, ids in zip(batch.column(0).slice(first, n).to_pylist(), encoder.encode(texts)):
                docs.append({"doc_id": doc, "at": total, "n_tokens": len(ids) + 1})
                waiting.extend((ids, np.array([end], "<u4")))
                many, total = many + len(ids) + 1, total + len(ids) + 1
                while many >= size:
                    yield flush(size)
    if many:
        yield flush(many)


def write_store(docs: DataFrame, path: str, tokenizer: str, end: int = 2, planes: str = "byte", block: int = BLOCK) -> None:
    """``tokenizer``: the vocabulary file of a byte-level vocabulary."""
    C.text_batches(docs.sparkSession)
    order = [F.col("doc_id"), F.xxhash64("text")]
    rows = docs.select("doc_id", "text").repartitionByRange(C.partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    rows.mapInArrow(lambda it: _blocks(it, tokenizer, end, planes, block), STORE.format(id=dict(docs.dtypes)["doc_id"])).write.parquet(path)


@tidied
def _read(batches):
    import pyarrow as pa

    names = ["shard", "doc_id", "at", "n_tokens", "part", "n", "crc"]
    for batch in batches:
        doc_id = batch.column(batch.schema.get_field_index("docs")).type.value_type.field("doc_id").type
        kinds, rows = [pa.int32(), doc_id, *[pa.int64()] * 5], []
        for r in batch.to_pylist():
            ids = unpack_block(r["block"])
            for d in r["docs"]:
                a, b = max(d["at"], r["first"]), min(d["at"] + d["n_tokens"], r["first"] + len(ids))
                rows.append((r["shard"], d["doc_id"], d["at"], d["n_tokens"], r["first"], b - a, zlib.crc32(ids[a - r["first"] : b - r["first"]])))
        cols = list(zip(*rows)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def _times(matrix: list[int], vector: int) -> int:
    out = i = 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector, i = vector >> 1, i + 1
    return out


_zeros: list[list[int]] = []


def crc_join(a: int, b: int, n: int) -> int:
    """The CRC-32 of two byte strings end to end, from theirs and the second's length:
    a's is moved past n zero bytes, by matrices over GF(2) for 1, 2, 4, ... of them."""
    if not _zeros:
        power = [0xEDB88320, *[1 << i for i in range(31)]]
        for k in range(43):
            power = [_times(power, x) for x in power]
            if k >= 2:
                _zeros.append(power)
    for power in _zeros:
        if n & 1:
            a = _times(power, a)
        n >>= 1
    return a ^ b


def _whole(parts: list) -> int:
    crc = 0
    for p in sorted(parts, key=lambda p: p["part"]):
        crc = crc_join(crc, p["crc"], 4 * p["n"])
    return crc


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the stored blocks."""
    blocks = spark.read.parquet(path)
    kind = blocks.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()
    parts = blocks.select("shard", "first", "block", "docs").mapInArrow(_read, f"shard int, doc_id {kind}, at long, n_tokens long, part long, n long, crc long")
    parts = C.stored(parts, "read-parts")
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("_all"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_before"))
    one = parts.filter("n = n_tokens").select("shard", "doc_id", "at", "n_tokens", F.col("crc").alias("ids_crc32"))
    join = F.udf(_whole, "long")
    more = parts.filter("n < n_tokens").groupBy("shard", "doc_id", "at", "n_tokens").agg(F.collect_list(F.struct("part", "n", "crc")).alias("_p"))
    more = more.select("shard", "doc_id", "at", "n_tokens", join("_p").alias("ids_crc32"))
    return one.unionByName(more).join(shards, "shard").select("doc_id", (F.col("_before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
