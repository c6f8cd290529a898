"""Putting ranked lists together: reciprocal ranks, reranking, regrouping, scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..tables import numbered

RANK_CONSTANT = 60


def reciprocal_rank_fusion(semantic: DataFrame, keyword: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of 1 / (60 + rank) over both whole lists, divided by the largest;
    ``matched_by``."""

    def ranked(df, name):
        return numbered(df.select(*keys, "score"), [F.desc("score"), *keys], name).drop("score")

    both = ranked(semantic, "s").join(ranked(keyword, "k"), keys, "full")
    part = lambda c: F.coalesce(1.0 / (RANK_CONSTANT + F.col(c)), F.lit(0.0))
    raw = both.withColumn("raw", part("s") + part("k"))
    top = raw.agg(F.max("raw").alias("top"))
    matched = F.when(F.col("s").isNotNull() & F.col("k").isNotNull(), "semantic,keyword").when(F.col("s").isNotNull(), "semantic").otherwise("keyword")
    return raw.crossJoin(F.broadcast(top)).select(*keys, F.round(F.col("raw") / F.col("top"), 6).alias("score"), matched.alias("matched_by"))


def _is(word: str):
    return lambda t: F.lower(t) == word


def rerank_bonus(query: str, as_of: str, tag_column: str, tag_weight: float, content: str | None) -> Column:
    """Title words, phrase, tags, recency and, for docs, density of content; at most 0.3."""
    words, phrase = query.lower().split(), query.lower()
    title = F.lower("title")
    bonus = F.lit(0.0)
    for w in words:
        bonus += X.boundary_count("title", w) * 0.03
        bonus += F.size(F.filter(tag_column, _is(w))) * tag_weight
        if content:
            bonus += F.least(X.boundary_count(content, w), F.lit(10)) * 0.005
    bonus += F.when(X.has_phrase("title", phrase), 0.15).when(title.contains(phrase), 0.05).otherwise(0.0)
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp"))) / 86_400_000_000.0
    bonus += F.when(F.col("updated_at").isNotNull() & (age < 7), 0.05 * (1 - age / 7)).otherwise(0.0)
    return F.least(bonus, F.lit(0.3))


def rerank(results: DataFrame) -> DataFrame:
    """``score`` + ``bonus``, again divided by the largest."""
    raw = results.withColumn("raw", F.col("score") + F.col("bonus"))
    top = raw.agg(F.max("raw").alias("top"))
    return raw.crossJoin(F.broadcast(top)).withColumn("score", F.round(F.when(F.col("top") > 0, F.col("raw") / F.col("top")).otherwise(F.col("raw")), 6)).drop("raw", "top")


def normalised_scores(results: DataFrame) -> DataFrame:
    """Scores over the largest to four places, half up; positive ones at least 0.01."""
    top = results.agg(F.max("score").alias("top"))
    share = F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(0.0)
    share = F.when((share > 0) & (share < 0.01), 0.01).otherwise(share)
    return results.crossJoin(F.broadcast(top)).withColumn("score", F.floor(share * 10000 + 0.5) / 10000).drop("top")


def regroup_tasks(results: DataFrame) -> DataFrame:
    """Tasks, sorted by lifecycle, score and title, take the places that tasks already
    hold in the list; other rows stay where they are.  ``results``: place, type, id,
    title, score, lifecycle."""
    life = F.when(F.col("lifecycle") == "active", 0).when(F.col("lifecycle") == "done", 1).otherwise(2)
    tasks = results.filter("type = 'task'")
    slots = numbered(tasks.select("place"), ["place"], "nth")
    sorted_ = numbered(tasks.drop("place"), [life, F.desc("score"), "title", "id"], "nth")
    return results.filter("type != 'task'").unionByName(sorted_.join(slots, "nth").select(*results.columns))
