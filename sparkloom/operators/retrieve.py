"""Retrieval packs: candidates in order of source, what they refer to, their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import refs as REFS
from .reports import LIVE_ORDER, place_in

SOURCES = ["doc", "decision", "task", "memory"]


def order() -> list[Column]:
    """Kind of source, lifecycle among tasks, score, title."""
    life = F.when(F.col("type") == "task", place_in("lifecycle", LIVE_ORDER)).otherwise(0)
    return [place_in("type", SOURCES), life, F.desc("score"), F.col("title"), F.col("id")]


def candidates(results: DataFrame, entities: DataFrame) -> DataFrame:
    """Results that still exist, with text: type, id, title, score, content, lifecycle.
    ``entities`` has type, id, title, content, lifecycle."""
    return results.select("type", "id", "score").join(entities, ["type", "id"]).withColumns({"direct": F.lit(True), "expanded_from": F.array().cast("array<string>")})


def expanded(found: DataFrame, entities: DataFrame) -> DataFrame:
    """One hop: what candidates refer to, at half the score of the best that does."""
    key = F.concat_ws(":", "type", "id")
    r = found.select(key.alias("_from"), "score", F.explode(REFS.extract(F.col("content"))).alias("raw"))
    r = r.select("_from", "score", REFS.parse(F.col("raw")).alias("r")).filter("r.valid")
    r = r.select(F.col("r.type").alias("type"), F.col("r.target").alias("id"), "_from", (F.col("score") * 0.5).alias("score"))
    best = r.groupBy("type", "id").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("_from")).alias("expanded_from"))
    return best.join(entities, ["type", "id"]).withColumn("direct", F.lit(False))


def merged(direct: DataFrame, more: DataFrame) -> DataFrame:
    """Direct candidates and expanded ones; one that is both is direct, with its
    origins."""
    keys = ["type", "id"]
    side = more.select(*keys, F.col("expanded_from").alias("_origins"))
    both = direct.join(side, keys, "left").withColumn("expanded_from", F.coalesce("_origins", "expanded_from")).drop("_origins")
    return both.unionByName(more.join(direct.select(*keys), keys, "left_anti").select(*both.columns))


def pack(found: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` in order, as place, citation and text."""
    top = found.orderBy(*order()).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*order())))
    text = F.trim(F.concat_ws("\n\n", F.nullif("title", F.lit("")), F.nullif("content", F.lit(""))))
    return top.select("place", F.struct("type", "id").alias("citation"), F.round("score", 6).alias("score"), "direct", F.array_join("expanded_from", ",").alias("expanded_from"), text.alias("text"))
