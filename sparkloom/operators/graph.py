"""Edges and walks over them.  Edge tables are (source, target, relation)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import tables as T

#: Which origin of an edge counts when several say the same.
ORIGIN_ORDER = ["field", "inline", "code"]


def dedup(edges: DataFrame) -> DataFrame:
    """One edge for each (source, target, relation): the one of first origin."""
    from .reports import place_in

    w = Window.partitionBy("source", "target", "relation").orderBy(place_in("origin", ORIGIN_ORDER), "origin")
    return edges.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def task_edges(tasks: DataFrame) -> DataFrame:
    """Edges from fields: parent, spec, and implements (the spec again)."""
    edge = lambda c, relation, kind: tasks.filter(F.col(c) != "").select(F.col("id").alias("source"), F.col(c).alias("target"), F.lit(relation).alias("relation"), F.lit("field").alias("origin"), F.lit(kind).alias("target_kind"))
    return edge("parent", "parent", "task").unionByName(edge("spec", "spec", "doc")).unionByName(edge("spec", "implements", "doc"))


def both_ways(edges: DataFrame) -> DataFrame:
    e = edges.select("source", "target")
    return e.unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target")))


def walk(edges: DataFrame, roots: DataFrame, depth: int = 3, direction: str = "outbound", relations: list[str] | None = None, kinds: list[str] | None = None) -> DataFrame:
    """Breadth-first to a fixed small depth: edges met, with the depth at which their
    near end is first reached.  One join for each level; visited nodes drop out.
    ``kinds`` keeps to far ends of these (what is before the slash of a node)."""
    e = edges.filter(F.col("relation").isin(relations)) if relations else edges
    out = e.select(F.col("source").alias("near"), F.col("target").alias("far"), "source", "target", "relation")
    back = e.select(F.col("target").alias("near"), F.col("source").alias("far"), "source", "target", "relation")
    steps = {"outbound": out, "inbound": back, "both": out.unionByName(back)}[direction]
    steps = steps.filter(F.split_part("far", F.lit("/"), F.lit(1)).isin(kinds)) if kinds else steps
    front = roots.select(F.col(roots.columns[0]).alias("near")).distinct()
    seen, found = [front], []
    for level in range(1, depth + 1):
        # written: the result, the next front and all later ones read it
        met = T.stored(steps.join(front, "near").withColumn("depth", F.lit(level)), "walk")
        found.append(met.select("source", "target", "relation", "depth"))
        if level < depth:
            front = T.stored(met.select(F.col("far").alias("near")).distinct().join(_union(seen), "near", "left_anti"), "front")
            seen.append(front)
    return _union(found)


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)


def distances(edges: DataFrame, root: str, most: int) -> DataFrame:
    """Fewest undirected steps from ``root`` to every node within ``most``."""
    steps = both_ways(edges)
    seen = [edges.sparkSession.createDataFrame([(root, 0)], "node string, hops int")]
    for hop in range(1, most + 1):
        met = steps.join(seen[-1].select(F.col("node").alias("source")), "source").select(F.col("target").alias("node")).distinct()
        seen.append(T.stored(met.join(_union(seen).select("node"), "node", "left_anti").withColumn("hops", F.lit(hop)), "front"))
    return _union(seen)


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def top_subgraph(edges: DataFrame, n: int = 300) -> DataFrame:
    """Edges among the n nodes of highest degree."""
    top = degrees(edges).orderBy(F.desc("degree"), "node").limit(n).select("node")
    one = edges.join(top.withColumnRenamed("node", "source"), "source", "left_semi")
    return one.join(top.withColumnRenamed("node", "target"), "target", "left_semi")


def knowledge_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends are both there and differ; the first of equal ones."""
    there = nodes.select("node").distinct()
    real = edges.filter("source != target")
    for end in ("source", "target"):
        real = real.join(there.withColumnRenamed("node", end), end, "left_semi")
    return real.select("source", "target", "relation").distinct()


def filtered_graph(nodes: DataFrame, edges: DataFrame, kinds: list[str], relations: list[str], hide_isolated: bool = True) -> DataFrame:
    """Nodes of some kinds with an edge of some relations between two of them."""
    some = nodes.filter(F.col("kind").isin(kinds))
    e = edges.filter(F.col("relation").isin(relations))
    for end in ("source", "target"):
        e = e.join(some.select(F.col("node").alias(end)), end, "left_semi")
    return some.join(both_ways(e).select(F.col("source").alias("node")).distinct(), "node", "left_semi") if hide_isolated else some


def ancestors(starts: DataFrame, parents: DataFrame) -> DataFrame:
    """(node, ancestor, steps) of the ids in ``starts``, with the fewest steps, whatever
    the length of a chain; on or above a cycle each of its nodes comes once.

    By doubling: after k rounds all ancestors within 2 ** k steps are there, and ``jump``
    leads from each node 2 ** k steps up.  A round that finds nothing new is the last:
    either no chain is longer, or all that are go round in circles."""
    up = parents.filter("parent != ''").select(F.col("id").alias("node"), F.col("parent").alias("to"))
    jump = T.stored(up, "jumps")
    found = T.stored(starts.select(F.col("id").alias("node")).distinct().join(jump, "node").select("node", F.col("to").alias("ancestor"), F.lit(1).cast("long").alias("steps")), "ancestors")
    size, far = found.count(), 1
    while True:
        hop = jump.select(F.col("node").alias("ancestor"), F.col("to").alias("_next"))
        more = found.join(hop, "ancestor").select("node", F.col("_next").alias("ancestor"), (F.col("steps") + far).alias("steps"))
        found = T.stored(found.unionByName(more).groupBy("node", "ancestor").agg(F.min("steps").alias("steps")), "ancestors")
        now = found.count()
        if now == size:
            return found
        size, far, jump = now, 2 * far, _doubled(jump)


def _doubled(jump: DataFrame) -> DataFrame:
    """Twice as far, for the nodes whose chain goes that far."""
    hop = jump.select(F.col("node").alias("to"), F.col("to").alias("_next"))
    return T.stored(jump.join(hop, "to").select("node", F.col("_next").alias("to")), "jumps")


def cycles(parents: DataFrame) -> DataFrame:
    """Nodes whose chain of parents never ends: those on a cycle and those that lead into
    one.  One row a node, and the table only shrinks: chains that end drop out, those of
    2 ** (k - 1) to 2 ** k steps in round k, so a round without loss is the last."""
    jump = T.stored(parents.filter("parent != ''").select(F.col("id").alias("node"), F.col("parent").alias("to")), "jumps")
    size = jump.count()
    while size:
        jump = _doubled(jump)
        now = jump.count()
        if now == size:
            break
        size = now
    return jump.select("node").distinct()


def roots(parents: DataFrame) -> DataFrame:
    """(node, root, depth) of every node with a parent: the end of its chain and the steps
    to it, one row a node by pointer doubling.  Chains that never end have no root."""
    up = parents.filter("parent != ''").select(F.col("id").alias("node"), F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth"))
    state, open_ = T.stored(up, "roots"), None
    while True:
        hop = state.select(F.col("node").alias("root"), F.col("root").alias("_next"), F.col("depth").alias("_more"))
        moved = state.join(hop, "root", "left")
        now = moved.filter("_next IS NOT NULL").count()
        if now in (0, open_):
            return moved.filter("_next IS NULL").select("node", "root", "depth")
        open_ = now
        state = T.stored(moved.select("node", F.coalesce("_next", "root").alias("root"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth")), "roots")


def impact(edges: DataFrame, root: str, most: int) -> DataFrame:
    """How many nodes lie at each distance."""
    return distances(edges, root, most).groupBy("hops").agg(F.count(F.lit(1)).alias("nodes"))
