"""Chunks: headings, sections, paragraphs, greedy packing, per entity.

A text's lines, headings and sections are arrays of the row, handled by folds and
transforms over them, so chunking is a projection and one explode: nothing is shuffled
and a document never meets another.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

MOST_TOKENS = 512


def paragraphs(c) -> Column:
    """Parts between two or more line breaks, trimmed, without blank ones."""
    parts = F.transform(F.split(F.coalesce(X.col(c), F.lit("")), r"\n\n+"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda p: p != "")


def estimate(c: Column) -> Column:
    return F.floor((F.octet_length(c) + 3) / 4).cast("int")


SECTION = T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in ("title", "path", "content")]]))


def _sections(text: str) -> list[tuple]:
    out, stack, body, fenced = [], [], [], False
    here = (0, "", "")
    for line in text.split("\n"):
        found = None if fenced else re.match(r"(#{1,6})\s+(\S.*)$", line)
        if line.strip().startswith("```"):
            fenced, found = not fenced, None
        if not found:
            body.append(line)
            continue
        out.append((*here, "\n".join(body).strip()))
        level, title = len(found[1]), found[2].strip()
        stack = [*[x for x in stack if x[0] < level], (level, title)]
        here, body = (level, title, "/".join(t for _, t in stack)), []
    return [*out, (*here, "\n".join(body).strip())]


@F.pandas_udf(SECTION)
def _headings(texts: pd.Series) -> pd.Series:
    names = ("level", "title", "path", "content")
    return texts.map(lambda t: [dict(zip(names, s)) for s in _sections(t or "")])


def headings(c) -> Column:
    """Sections (level, title, path of titles, body) under headings of level 1 to 6.
    Lines in fences are body; a heading of level n ends the titles of n and deeper.
    Text before the first heading is a section of level 0.  One pass over the lines in
    Arrow batches: a fold over arrays would copy what it has at every line."""
    return _headings(F.coalesce(X.col(c), F.lit("")))


def packed(parts: Column, first: Column, again: Column | None, most: int, filled: bool = False) -> Column:
    """Greedy packing: ``first`` heads the first chunk (or, if ``filled``, is its first
    part) and ``again`` each later one, if given; a chunk with something in it is closed
    when the next part would pass ``most`` tokens.
    A part that is too large by itself stays whole.  (content, tokens) of each."""
    kind = "array<struct<content:string,tokens:int>>"
    start = F.struct(F.array().cast(kind).alias("done"), first.alias("text"), estimate(first).alias("tokens"), F.lit(filled).alias("some"))

    def step(a, p):
        full = a["some"] & (a["tokens"] + estimate(p) > most)
        fresh = p if again is None else F.concat(again, F.lit("\n\n"), p)
        closed = F.concat(a["done"], F.array(F.struct(a["text"].alias("content"), a["tokens"].alias("tokens"))))
        return F.struct(
            F.when(full, closed).otherwise(a["done"]).alias("done"),
            F.when(full, fresh).otherwise(F.concat(a["text"], F.lit("\n\n"), p)).alias("text"),
            F.when(full, estimate(fresh)).otherwise(a["tokens"] + estimate(p)).alias("tokens"),
            F.lit(True).alias("some"),
        )

    end = F.aggregate(parts, start, step)
    return F.when(end["some"], F.concat(end["done"], F.array(F.struct(end["text"].alias("content"), end["tokens"].alias("tokens"))))).otherwise(end["done"])


def document_chunks(docs: DataFrame, most: int = MOST_TOKENS) -> DataFrame:
    """path, position, section, header_path, level, content, tokens.  Position 0 is the
    title, description and first body under a level-1 heading; then one chunk for each
    deeper section, split by paragraphs if too large; a text without headings is one."""
    d = docs.withColumn("_s", headings("content"))
    d = d.withColumn("_h", F.filter("_s", lambda s: s["level"] > 0))
    meta = F.concat_ws("\n\n", "title", F.nullif(F.coalesce("description", F.lit("")), F.lit("")), F.try_element_at(F.transform(F.filter("_h", lambda s: (s["level"] == 1) & (s["content"] != "")), lambda s: s["content"]), F.lit(1)))

    def one(s):
        name = F.concat(F.repeat(F.lit("#"), s["level"]), F.lit(" "), s["title"])
        whole = F.concat(name, F.lit("\n\n"), s["content"])
        split = packed(paragraphs(s["content"]), name, F.concat(name, F.lit(" (continued)")), most)
        parts = F.when(estimate(whole) > most, split).otherwise(F.array(F.struct(whole.alias("content"), estimate(whole).alias("tokens"))))
        return F.transform(parts, lambda p: F.struct(name.alias("section"), s["path"].alias("header_path"), s["level"].alias("level"), p["content"].alias("content"), p["tokens"].alias("tokens")))

    deep = F.flatten(F.transform(F.filter("_h", lambda s: s["level"] > 1), one))
    text = F.coalesce("content", F.lit(""))
    plain = F.when((F.size("_h") == 0) & (F.trim(text) != ""), F.array(F.struct(F.lit("# Content").alias("section"), F.lit("").alias("header_path"), F.lit(1).alias("level"), text.alias("content"), estimate(text).alias("tokens")))).otherwise(F.array().cast("array<struct<section:string,header_path:string,level:int,content:string,tokens:int>>"))
    first = F.array(F.struct(F.lit("# Metadata").alias("section"), F.lit("").alias("header_path"), F.lit(1).alias("level"), meta.alias("content"), estimate(meta).alias("tokens")))
    rows = d.select("path", F.posexplode(F.concat(first, deep, plain)).alias("position", "c"))
    return rows.select("path", "position", "c.*").withColumn("id", F.concat(F.lit("doc:"), "path", F.lit(":chunk:"), F.col("position").cast("string")))


def field_chunks(entities: DataFrame, kind: str, fields: list[str], most: int = MOST_TOKENS) -> DataFrame:
    """One chunk for each field that is not blank, split by paragraphs if too large;
    later parts are named ``:n`` from 2."""

    def one(c):
        text = F.coalesce(F.col(c), F.lit(""))
        paras = paragraphs(c)
        head = F.element_at(paras, 1)
        parts = F.when(estimate(text) > most, packed(F.slice(paras, F.lit(2), F.greatest(F.size(paras) - 1, F.lit(0))), head, None, most, filled=True)).otherwise(F.array(F.struct(text.alias("content"), estimate(text).alias("tokens"))))
        named = F.transform(parts, lambda p, i: F.struct(F.when(i == 0, c).otherwise(F.concat(F.lit(c + ":"), (i + 1).cast("string"))).alias("part"), p["content"].alias("content"), p["tokens"].alias("tokens")))
        return F.when(F.trim(text) != "", named).otherwise(F.array().cast("array<struct<part:string,content:string,tokens:int>>"))

    rows = entities.select("id", F.explode(F.flatten(F.array(*map(one, fields)))).alias("c"))
    return rows.select(F.concat_ws(":", F.lit(kind), "id", "c.part").alias("chunk_id"), "id", "c.part", "c.content", "c.tokens")


def section_of(c, wanted: str) -> Column:
    """The body of the first section whose title is ``wanted`` or contains it."""
    s = F.filter(headings(c), lambda x: x["level"] > 0)
    exact = F.filter(s, lambda x: F.lower(x["title"]) == wanted.lower())
    part = F.filter(s, lambda x: F.lower(x["title"]).contains(wanted.lower()))
    return F.coalesce(F.try_element_at(F.transform(exact, lambda x: x["content"]), F.lit(1)), F.try_element_at(F.transform(part, lambda x: x["content"]), F.lit(1)))


def outline(c) -> Column:
    """The headings as indented lines."""
    s = F.filter(headings(c), lambda x: x["level"] > 0)
    return F.array_join(F.transform(s, lambda x: F.concat(F.repeat(F.lit("  "), x["level"] - 1), F.lit("- "), x["title"])), "\n")


def smart_read(c, most: int = 2000) -> Column:
    """The whole text up to ``most`` tokens, else its outline."""
    return F.when(F.floor(F.length(X.col(c)) / 4) <= most, X.col(c)).otherwise(outline(c))


def lines(c, first: int, last: int) -> Column:
    """Lines first..last, counted from 1."""
    return F.array_join(F.slice(F.split(X.col(c), "\n"), first, last - first + 1), "\n")


def replace_section(df: DataFrame, text: str, wanted: str, body: str) -> DataFrame:
    """``text`` with the first section that is named by number, by title or by a part of
    it replaced by ``body`` (heading included); a section holds its deeper ones.  A blank
    line at its end stays.  Adds ``replaced``: whether there was one."""
    name = wanted.strip().lstrip("# ").strip()
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    level = lambda x: F.length(F.regexp_extract(x, r"^(#+)(?= |\z)", 1))
    d = df.withColumn("_l", F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1))
    d = d.withColumn("_h", F.filter(F.transform("_l", lambda x, i: F.struct(i.alias("at"), level(x).alias("level"), trimmed(F.substr(x, level(x) + 1)).alias("title"))), lambda h: h["level"] > 0))
    named = F.transform(F.filter("_h", lambda h: h["title"] != ""), lambda h, i: F.struct(h["at"].alias("at"), h["level"].alias("level"), h["title"].alias("title"), (i + 1).cast("string").alias("number")))
    fits = lambda h: (h["number"] == name) | F.lower(h["title"]).contains(name.lower())
    d = d.withColumn("_s", F.try_element_at(F.filter(named, fits), F.lit(1)))
    after = F.filter("_h", lambda h: (h["at"] > F.col("_s.at")) & (h["level"] <= F.col("_s.level")))
    d = d.withColumn("_e", F.coalesce(F.try_element_at(after, F.lit(1))["at"], F.size("_l")))
    fresh = body.split("\n")
    blank = (trimmed(F.element_at("_l", F.col("_e"))) == "") & (F.col("_e") > F.col("_s.at") + 1) & F.lit(fresh[-1].strip() != "")
    middle = F.when(blank, F.array(*map(F.lit, [*fresh, ""]))).otherwise(F.array(*map(F.lit, fresh)))
    whole = F.concat(F.slice("_l", F.lit(1), F.col("_s.at")), middle, F.slice("_l", F.col("_e") + 1, F.size("_l")))
    return d.withColumns({"replaced": F.col("_s").isNotNull(), text: F.when(F.col("_s").isNotNull(), F.array_join(whole, "\n")).otherwise(F.col(text))}).drop("_l", "_h", "_s", "_e")
