"""Exact vector top-k over stored cells, for a table of queries at once.

Vectors of a length are scaled to length one and go to the nearest of a bounded number of
centres; a cell keeps its centre and the widest angle to any of its members.  By the triangle
inequality of angles nothing in a cell is nearer to a query than the query's angle to the centre
less that width.  Each query first scores the cells nearest to it that hold k vectors; its k-th best
similarity there (or the threshold, if that is more) is what a cell must be able to reach, and
cells that cannot are left out.  The result is that of ``vector.top_k``, whatever the centres.

Vectors without a length (empty, null or zero) and those of other lengths than the query's have
similarity 0.  They are a cell of their own for each length, and count where the threshold
lets 0 in.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import tables as T
from . import vector as V

#: Vectors of a cell, and queries, that meet in one task.
BLOCK, ASKED = 4096, 8192
#: Angles are computed in double precision; this is far more than they can be off by.
SLACK = 1e-6


def _units(values: list) -> np.ndarray:
    x = np.array(values, np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _placed(centres: dict[int, np.ndarray]):
    """Rows with the nearest centre and the angle to it; -1 for vectors without direction."""

    def run(frames):
        for df in frames:
            cell, angle = np.full(len(df), -1), np.zeros(len(df))
            sizes = df["dims"].to_numpy()
            for size in set(sizes.tolist()) & set(centres):
                at = np.flatnonzero((sizes == size) & df["whole"].to_numpy())
                if len(at):
                    near = np.clip(_units(df["embedding"].iloc[at].tolist()) @ centres[size].T, -1, 1)
                    cell[at] = near.argmax(axis=1)
                    angle[at] = np.arccos(near[np.arange(len(at)), cell[at]])
            yield df.assign(cell=cell, angle=angle)

    return run


def _close(k: int, threshold: float):
    """Of a block of vectors and one of queries the pairs that may be among the k best of a query,
    with their similarity to within far less than the six places that count."""

    def cosines(q, v) -> np.ndarray:
        out = np.zeros((len(q), len(v)))
        at = np.flatnonzero(v["whole"].to_numpy())
        if len(at):
            units = _units(v["embedding"].iloc[at].tolist())
            fit = np.flatnonzero([x is not None and len(x) == units.shape[1] for x in q["query"]])
            if len(fit):
                asked = np.array(q["query"].iloc[fit].tolist(), np.float64)
                size = np.sqrt((asked * asked).sum(axis=1, keepdims=True))
                with np.errstate(all="ignore"):
                    out[np.ix_(fit, at)] = np.nan_to_num(np.where(size > 0, asked / size, 0.0), nan=0.0) @ units.T
        return out

    def run(v, q):
        found = []
        for start in range(0, len(q), 512):
            some = q.iloc[start : start + 512]
            near = cosines(some, v)
            least = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(some), -2.0)
            rows, at = np.nonzero(near >= np.maximum(least, threshold)[:, None] - 2e-6)
            found.append(pd.DataFrame({"qid": some["qid"].to_numpy()[rows], "vec_id": v["vec_id"].to_numpy()[at], "near": near[rows, at]}))
        return pd.concat(found) if found else pd.DataFrame({"qid": [], "vec_id": [], "near": []})

    return run


class Cells:
    """Stored cells of ``vectors`` (``vec_id``, ``embedding`` and any other columns)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def build(self, vectors: DataFrame, cells: int = 64) -> None:
        """``cells``: centres for each length of vectors, taken from the rows whose ids hash
        lowest, so that they do not grow with the table."""
        whole = F.coalesce(V.norm("embedding"), F.lit(0.0)) > 0
        rows = vectors.withColumns({"dims": F.coalesce(F.size("embedding"), F.lit(-1)), "whole": whole})
        drawn = Window.partitionBy("dims").orderBy(F.xxhash64("vec_id"), "vec_id")
        centres: dict[int, list] = {}
        for r in rows.filter("whole").select("dims", "embedding", F.row_number().over(drawn).alias("n")).filter(F.col("n") <= cells).collect():
            centres.setdefault(r["dims"], []).append(list(r["embedding"]))
        held = {size: _units(some) for size, some in centres.items()}
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + ["cell int", "angle double"])
        placed = T.stored(rows.mapInPandas(_placed(held), schema), "cell-rows")
        n = T.partitions(self.spark)
        placed.drop("whole").repartitionByRange(n, "dims", "cell", "vec_id").sortWithinPartitions("dims", "cell", "vec_id").write.parquet(f"{self.path}/vectors")
        middle = [(size, i, c.tolist()) for size, some in held.items() for i, c in enumerate(some)]
        middle = self.spark.createDataFrame(middle, "dims int, cell int, centre array<double>")
        width = placed.groupBy("dims", "cell").agg(F.max("angle").alias("width"), F.count(F.lit(1)).alias("n"))
        width.join(middle, ["dims", "cell"], "left").coalesce(1).write.parquet(f"{self.path}/cells")

    def reach(self, queries: DataFrame) -> DataFrame:
        """``qid, query, dims, cell, n, most``: the most that any vector of each cell can have.
        Cells are at most a fixed number for each length of vectors."""
        cells = self.spark.read.parquet(f"{self.path}/cells")
        met = queries.select("qid", "query", F.size("query").alias("q_dims")).crossJoin(F.broadcast(cells))
        beside = F.acos(F.greatest(F.least(V.cosine(F.col("query"), F.col("centre")), F.lit(1.0)), F.lit(-1.0)))
        least = F.greatest(beside - F.col("width") - SLACK, F.lit(0.0))
        most = F.when((F.col("cell") < 0) | (F.col("dims") != F.col("q_dims")) | (F.coalesce(V.norm("query"), F.lit(0.0)) == 0), 0.0).otherwise(F.cos(least))
        return met.select("qid", "query", "dims", "cell", "n", most.alias("most"))

    def _scored(self, asked: DataFrame, k: int, threshold: float, kind: str | None) -> DataFrame:
        """Scores of the k best vectors of each query in its cells (``asked``: qid, query, dims, cell), and of
        those too near to the k-th to tell.  Blocks of vectors meet blocks of queries as matrices; what
        may count is then scored as ``vector.cosine`` does."""
        rows = self.spark.read.parquet(f"{self.path}/vectors")
        rows = rows if kind is None else rows.filter(F.col("type") == kind)
        # a row for each cell
        parts = F.broadcast(self.spark.read.parquet(f"{self.path}/cells").select("dims", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
        turns = max(1, -(-asked.select("qid").distinct().count() // ASKED))
        v = rows.select("vec_id", "embedding", "dims", "cell", (F.col("cell") >= 0).alias("whole")).join(parts, ["dims", "cell"])
        v = v.withColumns({"block": F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"), "turn": F.explode(F.sequence(F.lit(0), F.lit(turns - 1)))}).drop("blocks")
        q = asked.select("qid", "query", "dims", "cell").join(parts, ["dims", "cell"])
        q = q.withColumns({"turn": F.pmod(F.xxhash64("qid"), F.lit(turns)).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))}).drop("blocks")
        keys = ["dims", "cell", "block", "turn"]
        kinds = dict(asked.dtypes) | dict(rows.dtypes)
        found = v.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInPandas(_close(k, threshold), f"qid {kinds['qid']}, vec_id {kinds['vec_id']}, near double")
        found = T.stored(found, "cell-near")
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("near")))
        least = found.withColumn("n", place).filter(F.col("n") <= k).groupBy("qid").agg(F.when(F.count(F.lit(1)) == k, F.min("near")).alias("least"))
        found = found.join(least, "qid").filter(F.col("near") >= F.coalesce("least", F.lit(-2.0)) - 2e-6).select("qid", "vec_id").distinct()
        met = rows.join(found, "vec_id").join(asked.groupBy("qid").agg(F.first("query").alias("query")), "qid")
        return met.withColumn("score", F.round(V.cosine(F.col("embedding"), F.col("query")), 6)).drop("query", "angle", "dims", "cell")

    def searched(self, queries: DataFrame, k: int, threshold: float, kind: str | None = None) -> DataFrame:
        """The cells of each query, with ``least`` and whether they are ``live``."""
        reach = T.stored(self.reach(queries), "cell-reach")
        order = Window.partitionBy("qid").orderBy(F.desc("most"), "dims", "cell")
        before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        first = reach.withColumn("before", before).filter(F.col("before") < k)
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score")))
        kth = self._scored(first, k, -1.0, kind).select("qid", "score", place.alias("place")).filter(F.col("place") == k)
        out = reach.join(kth.select("qid", "score"), "qid", "left")
        least = F.greatest(F.coalesce("score", F.lit(threshold)), F.lit(threshold))
        # similarities are rounded to six places
        return out.select(*reach.columns, least.alias("least"), (F.col("most") + 1e-6 >= least).alias("live"))

    def top_k(self, queries: DataFrame, k: int = V.TOP, threshold: float = V.THRESHOLD, kind: str | None = None) -> DataFrame:
        """``qid, place, score`` and the columns of the vectors: the k most like each query of
        ``queries`` (``qid, query``)."""
        live = T.stored(self.searched(queries, k, threshold, kind).filter("live"), "live-cells")
        order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
        found = self._scored(live, k, threshold, kind).filter(F.col("score") >= threshold)
        return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
