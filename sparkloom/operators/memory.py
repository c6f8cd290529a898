"""Prompt-time memory: scoring, thresholds, packing into a byte budget, capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Prompts of at most two such words say nothing.
LOW_SIGNAL = ["again", "continue", "go", "hello", "hey", "hi", "next", "no", "ok", "okay", "retry", "sure", "thank", "thanks", "yes"]
BASELINE_TAGS = ["preference", "convention", "style", "runtime-memory", "runtime"]


def recency(updated: str, as_of: str) -> Column:
    days = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col(updated).cast("timestamp"))) / 86_400_000_000.0
    return F.when(days.isNull(), 0.0).when(days <= 7, 0.12).when(days <= 30, 0.06).when(days <= 90, 0.03).otherwise(0.0)


def low_signal(prompt) -> Column:
    """Empty, shorter than three bytes, wordless, or up to two words that all say nothing."""
    p, words = X.squeeze(prompt), X.tokens(prompt)
    return (F.octet_length(p) < 3) | (F.size(words) == 0) | ((F.size(words) <= 2) & F.forall(words, lambda w: w.isin(LOW_SIGNAL)))


def scored(memories: DataFrame, prompt: str, context: list[str], runtime: str, action: str, as_of: str) -> DataFrame:
    """Adds overlap and score; entries that share no word with the prompt go."""
    unique = lambda *parts: sorted({t for p in parts for t in X.query_tokens(p) if len(t) >= 3})
    words = F.array_distinct(F.concat(*[X.unique_tokens(c) for c in ("title", "category", "content")], X.unique_tokens(F.array_join("tags", " "))))
    literal = lambda ws: F.array(*map(F.lit, ws)) if ws else F.array().cast("array<string>")
    m = memories.withColumn("_w", words)
    hits = lambda ws: F.size(F.array_intersect("_w", literal(ws)))
    score = F.when(F.col("layer") == "project", 0.12).when(F.col("layer") == "global", 0.04).otherwise(0.0)
    score += hits(unique(prompt)) * 0.35 + hits(unique(runtime, *context, action)) * 0.05
    score += F.when(hits(unique(runtime)) > 0, 0.08).otherwise(0.0) + F.when(hits(unique(action)) > 0, 0.08).otherwise(0.0)
    score += recency("updated_at", as_of)
    m = m.withColumns({"overlap": hits(unique(prompt)), "score": F.round(score, 6)})
    return m.filter("overlap > 0").drop("_w")


def baseline(memories: DataFrame, as_of: str) -> DataFrame:
    """Scores for the start of a session, without a prompt."""
    score = F.when(F.col("layer") == "project", 0.2).when(F.col("layer") == "global", 0.14).otherwise(0.0) + recency("updated_at", as_of)
    score += F.size(F.filter("tags", lambda t: F.lower(F.trim(t)).isin(BASELINE_TAGS))) * 0.08
    return memories.withColumn("score", F.round(score, 6))


def hybrid(semantic: DataFrame, entries: DataFrame) -> DataFrame:
    """Semantic scores above 0.75 of entries that share a word, capped at 1.2, added."""
    s = semantic.select("id", F.col("score").alias("_s")).filter("_s > 0.75")
    return entries.join(s, "id").filter("overlap >= 1").withColumn("score", F.col("score") + F.least(F.greatest("_s", F.lit(0.0)), F.lit(1.2))).drop("_s")


def top(entries: DataFrame, n: int = 5) -> DataFrame:
    return entries.orderBy(F.desc("score"), F.desc("updated_at"), "id").limit(n)


def passes_threshold(items: DataFrame) -> DataFrame:
    """One row: the best at least 0.85, and the sum at least 1.1 for one or 1.4 for more."""
    s = items.agg(F.max("score").alias("best"), F.sum("score").alias("total"), F.count(F.lit(1)).alias("n"))
    ok = (F.col("best") >= 0.85) & (F.col("total") >= F.when(F.col("n") == 1, 1.1).otherwise(1.4))
    return s.select("n", F.coalesce(ok, F.lit(False)).alias("inject"))


def packed(items: DataFrame, group: list[str], order: list[Column], size: str, budget: int) -> DataFrame:
    """Items in order while they fit in ``budget`` bytes; the first that does not fit is
    the last, with ``room`` for the part of it that does.  A running sum by group."""
    w = Window.partitionBy(*group).orderBy(*order)
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = items.withColumns({"room": F.lit(budget) - before, "n": F.row_number().over(w)}).filter("room > 0")
    return rows.withColumn("truncated", F.col(size) > F.col("room")).withColumn("room", F.least(F.col("room"), F.col(size)))


def duplicate_capture(captured: DataFrame, entries: DataFrame) -> DataFrame:
    """Captured rows whose content is an entry's, or that share layer and title with one
    and contain it or lie in it."""
    e = entries.select(F.col("id").alias("_id"), F.col("layer").alias("_l"), X.squeeze("title").alias("_t"), X.squeeze("content").alias("_c"))
    c = captured.withColumns({"_title": X.squeeze("title"), "_content": X.squeeze("content")})
    equal = c.join(e, (F.col("_content") == F.col("_c")) & (F.col("id") != F.col("_id")), "left_semi")
    near = c.join(e, (F.col("layer") == F.col("_l")) & (F.col("_title") == F.col("_t")) & (F.col("id") != F.col("_id")) & (F.col("_c").contains(F.col("_content")) | F.col("_content").contains(F.col("_c"))), "left_semi")
    return equal.unionByName(near).select("id").distinct()


def inferred(prompts: DataFrame, text: str, phrases: dict[str, tuple[float, list[str]]], least: float = 0.8) -> DataFrame:
    """kind and confidence by the first kind one of whose phrases the text contains."""
    low = X.squeeze(text)
    any_of = lambda ps: F.exists(F.array(*map(F.lit, ps)), lambda p: low.contains(p))
    kind, sure = F.lit(None).cast("string"), F.lit(0.0)
    for name, (confidence, ps) in reversed(phrases.items()):
        kind, sure = F.when(any_of(ps), name).otherwise(kind), F.when(any_of(ps), confidence).otherwise(sure)
    return prompts.withColumns({"kind": kind, "confidence": sure}).filter(F.col("confidence") >= least)
