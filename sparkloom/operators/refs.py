"""Semantic references in text: finding, parsing, resolving and rewriting them.

Forms: ``@doc/path#heading``, ``@doc/path:3-9``, ``@task/id``, ``@memory/id``,
``@decision/id``, ``@template/id``, the older ``@task-id`` and ``@memory-id``, and
``{relation}`` after any of them.  Fenced code is skipped; a fence opens and closes at
the start of a line only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relation names.
RELATIONS = ["implements", "depends", "blocked-by", "follows", "related", "parent", "spec", "imported-from", "template-for", "references"]
NAMESPACES = ["doc", "task", "memory", "decision", "template"]
PATTERN = r"(@(?:(?:doc|task|memory|decision|template)/[A-Za-z0-9_./#:\-]+|(?:task|memory)-[A-Za-z0-9_\-.]+)(?:\{[a-z\-]+\})?)"
FENCED = r"(?ms)^```.*?^```|^```.*\z"


def without_fences(c: Column) -> Column:
    return F.regexp_replace(c, FENCED, "")


def extract(c: Column) -> Column:
    """All references of a text in order, as written, less trailing punctuation."""
    found = F.regexp_extract_all(without_fences(F.coalesce(c, F.lit(""))), F.lit(PATTERN), 1)
    return F.transform(found, lambda r: F.regexp_replace(r, r"[\s.,;:!?`'\"]+$", ""))


def parse(raw: Column) -> Column:
    """type, target, fragment, relation, valid, legacy, canonical of one reference."""
    body = F.regexp_extract(raw, r"^@([^{]*)", 1)
    relation = F.regexp_extract(raw, r"\{([^}]*)\}$", 1)
    legacy = body.rlike(r"^(task|memory)-")
    kind = F.regexp_extract(body, r"^([a-z]+)[/-]", 1)
    rest = F.regexp_replace(body, r"^[a-z]+[/-]", "")
    fragment = F.when(kind == "doc", F.regexp_extract(rest, r"(#.*|:\d+-\d+|:\d+)$", 1)).otherwise("")
    target = F.regexp_replace(F.when(F.length(fragment) > 0, F.substring(rest, F.lit(1), F.length(rest) - F.length(fragment))).otherwise(rest), r"[\s.,;:!?`'\"]+$", "")
    named = F.when(relation == "", "references").otherwise(relation)
    canonical = F.concat(F.lit("@"), kind, F.lit("/"), target, fragment, F.when(relation != "", F.concat(F.lit("{"), relation, F.lit("}"))).otherwise(""))
    return F.struct(kind.alias("type"), target.alias("target"), fragment.alias("fragment"), named.alias("relation"), named.isin(RELATIONS).alias("valid"), legacy.alias("legacy"), canonical.alias("canonical"))


def references(df: DataFrame, source: str, text: str) -> DataFrame:
    """One row for each reference of each source, with its place."""
    rows = df.select(F.col(source).alias("source"), F.posexplode(extract(F.col(text))).alias("place", "raw"))
    return rows.select("source", "place", "raw", parse(F.col("raw")).alias("r")).select("source", "place", "raw", "r.*").filter("target != ''")


def resolve(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """``resolved``: whether an entity (type, id) of that name is there."""
    known = entities.select("type", F.col("id").alias("target")).distinct().withColumn("_there", F.lit(True))
    return refs.join(known, ["type", "target"], "left").withColumn("resolved", F.coalesce("_there", F.lit(False))).drop("_there")


def rewrite_doc_path(c: Column, old: str, new: str) -> Column:
    """The same text with references to ``old`` now to ``new``; fragments and relations
    stay, and longer paths that begin alike are left alone."""
    import re

    return F.regexp_replace(c, rf"@doc/{re.escape(old)}(?![A-Za-z0-9_/\-]|\.[A-Za-z0-9])", f"@doc/{new}")
