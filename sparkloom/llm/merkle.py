"""Operator 12: a Merkle manifest of a table, with a proof and a fold for every row.

Each row is a leaf.  Within a source the leaves, in order of ``doc_id``, are hashed up in
runs of ``arity``; the subroots, in order of source, likewise give the root.  This is the
variant with a broadcast upper tree:

1. leaves get their place in their source from a distributed sort;
2. blocks of ``arity ** height`` consecutive leaves are reduced where they lie, and kept as
   one row each; while more than ``top`` nodes are left, blocks of nodes are reduced likewise;
3. the driver builds the small tree above (at most ``top`` nodes) and sends each node's
   suffix path, that is its siblings from there to the root, to all executors;
4. each block finishes its rows: siblings within the block and then the suffix path are the
   row's proof, and folding the (changed) leaf with them gives the root it leads to.

Everything but step 3 is SQL functions.  A path is an array of (left, right): the siblings
to the left and right of the node on its way, joined; a run of one has neither.

Cases: a null field is ``-``; a null source is the first source; null doc_ids come first in
their source and are not tampered with; equal doc_ids are ordered by leaf, so repeated rows
lie side by side, and equal leaves share their results as a set; texts are hashed whole;
columns other than the five fields have no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<l: string, r: string>>"


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def _over(nodes: Column, arity: int) -> Column:
    """The level above an array of nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / arity).cast("int"))
    return F.transform(runs, lambda j: F.sha2(F.array_join(F.slice(nodes, j * arity + 1, F.lit(arity)), ""), 256))


def _joined(nodes: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(nodes, first + 1, n), "")


def _siblings(levels: list[Column], at: Column, arity: int) -> Column:
    """The path of the node at place ``at`` of the lowest level through the block."""
    steps = []
    for nodes in levels:
        low = F.floor(at / arity).cast("int") * arity
        steps.append(F.struct(_joined(nodes, low, at - low).alias("l"), _joined(nodes, at + 1, F.greatest(low + arity - at - 1, F.lit(0))).alias("r")))
        at = F.floor(at / arity).cast("int")
    return F.array(*steps)


def blocks_of(nodes: DataFrame, columns: list[str], arity: int, height: int) -> DataFrame:
    """``source, block, rows`` (the given columns, by place) ``, l0, l1, ...`` (the nodes of each
    level below the block's own), ``node`` of each block of consecutive nodes.

    The first block of a source goes up until one node is left, the others ``height`` levels: a
    first block that is followed by others is full, so that it is the same."""
    size = arity**height
    block = F.floor(F.col("at") / size).cast("long").alias("block")
    out = nodes.groupBy("source", block).agg(F.sort_array(F.collect_list(F.struct("at", *columns))).alias("rows"))
    level = F.col("rows.node")
    for k in range(height):
        out = out.withColumn(f"l{k}", level)
        # levels of a small only block that is already one node are empty and add no step
        done = (F.col("block") == 0) & (F.size(F.col(f"l{k}")) <= 1)
        out = out.withColumn("node", F.coalesce(F.when(done, F.get(f"l{k}", F.lit(0))), F.col("node") if k else F.lit(None).cast("string")))
        out = out.withColumn(f"l{k}", F.when(done, F.array().cast("array<string>")).otherwise(F.col(f"l{k}")))
        level = F.when(F.size(f"l{k}") > 0, _over(F.col(f"l{k}"), arity)).otherwise(F.array().cast("array<string>"))
    return C.stored(out.withColumn("node", F.coalesce("node", F.get(level, F.lit(0)))), "merkle-blocks")


def _path_in(block_height: int, arity: int, at: Column) -> Column:
    """The path of the block's row at ``at``; only levels that are not empty have a step."""
    steps = _siblings([F.col(f"l{k}") for k in range(block_height)], at, arity)
    taken = sum((F.size(f"l{k}") > 0).cast("int") for k in range(block_height))
    return F.slice(steps, F.lit(1), taken)


def climb(nodes: list[str], arity: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The node above all, and each node's path to it."""
    paths: list[list[tuple[str, str]]] = [[] for _ in nodes]
    below = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        over, held = [], []
        for first in range(0, len(nodes), arity):
            run = nodes[first : first + arity]
            for i in range(len(run)):
                step = ("".join(run[:i]), "".join(run[i + 1 :]))
                for x in below[first + i]:
                    paths[x].append(step)
            over.append(hashlib.sha256("".join(run).encode()).hexdigest())
            held.append([x for b in below[first : first + arity] for x in b])
        nodes, below = over, held
    return nodes[0], paths


def _upper_tree(nodes: DataFrame, arity: int) -> tuple[list[tuple], str | None]:
    """(source, at, path, subroot) of each node, and the root."""
    rows = sorted(nodes.collect(), key=lambda r: (r["source"] is not None, (r["source"] or "").encode(), r["at"]))
    by_source: dict[str | None, list[str]] = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r["node"])
    if not rows:
        return [], None
    own = {s: climb(n, arity) for s, n in by_source.items()}
    root, above = climb([subroot for subroot, _ in own.values()], arity)
    out = []
    for (source, (subroot, paths)), upper in zip(own.items(), above):
        out += [(source, at, path + upper, subroot) for at, path in enumerate(paths)]
    return out, root


def _finished(nodes: DataFrame, arity: int, height: int, top: int) -> tuple[DataFrame, str | None]:
    """``source, at, path, subroot`` for every node (``source, at, node``), and the root."""
    spark = nodes.sparkSession
    n, sources = nodes.agg(F.count(F.lit(1)), F.count_distinct(F.struct("source"))).first()
    kind = f"source string, at long, path {PATH}, subroot string"
    if n <= top:
        rows, root = _upper_tree(nodes, arity)
        return F.broadcast(spark.createDataFrame(rows, kind)), root
    if n > sources:
        blocks = blocks_of(nodes, ["node"], arity, height)
        up, root = _finished(blocks.select("source", F.col("block").alias("at"), "node"), arity, height, top)
        held = blocks.alias("b").join(up.alias("u"), F.col("b.source").eqNullSafe(F.col("u.source")) & (F.col("b.block") == F.col("u.at")))
        held = held.select("b.*", "u.path", "u.subroot")
        each = F.transform("rows", lambda r: F.struct(r["at"].alias("at"), F.concat(_path_in(height, arity, F.pmod(r["at"], F.lit(arity**height)).cast("int")), F.col("path")).alias("path")))
        return C.stored(held.select("source", F.explode(each).alias("x"), "subroot").select("source", "x.at", "x.path", "subroot"), "merkle-paths"), root
    # more sources than the driver takes: the subroots are the leaves of one more tree
    placed = C.stored(C.ranked(nodes.withColumn("_all", F.lit(0)), "_all", ["source"]).select("source", "at", F.col("rank").cast("long").alias("place"), "node"), "merkle-subroots")
    up, root = _finished(placed.select(F.lit(None).cast("string").alias("source"), F.col("place").alias("at"), "node"), arity, height, top)
    up = up.select(F.col("at").alias("place"), "path")
    return placed.join(up, "place").select("source", "at", "path", F.col("node").alias("subroot")), root


def manifest(docs: DataFrame, changed: Column | None = None, arity: int = 16, height: int = 2, top: int = 4096) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for each row.

    ``changed``: the text that a verifier sees instead of a row's own, where it is not null;
    without it all rows verify."""
    text = F.col("text") if changed is None else F.coalesce(changed, F.col("text"))
    own = [F.col(c) for c in FIELDS]
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), leaf(*own).alias("node"), leaf(*own[:-1], text).alias("seen"))
    rows = C.ranked(rows, "source", ["doc_id", "node"]).withColumn("at", F.col("rank").cast("long"))
    blocks = blocks_of(rows.select("source", "at", "doc_id", "node", "seen"), ["doc_id", "node", "seen"], arity, height)
    up, root = _finished(blocks.select("source", F.col("block").alias("at"), "node"), arity, height, top)
    held = blocks.alias("b").join(up.alias("u"), F.col("b.source").eqNullSafe(F.col("u.source")) & (F.col("b.block") == F.col("u.at")))
    held = held.select("b.*", "u.path", "u.subroot")

    def finish(r: Column) -> Column:
        path = F.concat(_path_in(height, arity, F.pmod(r["at"], F.lit(arity**height)).cast("int")), F.col("path"))
        return F.struct(r["doc_id"].alias("doc_id"), r["node"].alias("leaf"), r["seen"].alias("seen"), path.alias("path"))

    out = held.select("subroot", F.explode(F.transform("rows", finish)).alias("x"))
    proof = F.sha2(F.array_join(F.transform("x.path", lambda s: F.concat(s["l"], s["r"])), ""), 256)
    folded = F.aggregate("x.path", F.col("x.seen"), lambda d, s: F.sha2(F.concat(s["l"], d, s["r"]), 256))
    out = out.select("x.doc_id", "x.leaf", "subroot", F.lit(root).cast("string").alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered_fifth(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The tampering of the contract: A-Z lower-cased where 5 divides the CRC of doc_id."""
    crc = F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8"))
    return F.when(crc % 5 == 0, C.ascii_lower(F.col(text)))
