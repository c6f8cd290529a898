"""Entities from trees of Markdown files with a front matter: tasks, docs, memories,
decisions and templates.

Files are read whole by Spark's text reader, so any store that Spark reads will do;
what the front matter holds is picked by expressions.  Files without one, or whose
needed keys are missing, are skipped in lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.index import latest
from ..operators.reports import place_in

#: Marks of sections in a task's body: the newer form, then the older one.
MARKS = [("<!-- SECTION:{}:BEGIN -->", "<!-- SECTION:{}:END -->"), ("<!-- {}:BEGIN -->", "<!-- {}:END -->")]


def files(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """path below ``root`` without its ending, and text; folders are entered."""
    base = root.rstrip("/") + "/"
    d = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), F.lit(base.split("://")[-1]), 2), -1)
    return d.select(F.regexp_replace(F.url_decode(name), r"\.[^./]+$", "").alias("path"), F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "\r\n", "\n").alias("text"))


def split_front_matter(d: DataFrame) -> DataFrame:
    """``front`` and ``body``; a text without fences is all body."""
    fence = r"(?s)^---\n(.*?)\n---\n?(.*)$"
    has = F.col("text").rlike(fence)
    return d.withColumns({"front": F.when(has, F.regexp_extract("text", fence, 1)).otherwise(""), "body": F.when(has, F.regexp_extract("text", fence, 2)).otherwise(F.col("text"))})


def _unquoted(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"""^(["'])(.*)\1$""", "$2")


def scalar(name: str) -> Column:
    """A key of the front matter; null if it is not there."""
    found = F.regexp_extract("front", rf"(?m)^{name}:[ \t]*(.*)$", 1)
    return F.when(F.col("front").rlike(rf"(?m)^{name}:"), _unquoted(found))


def listing(name: str) -> Column:
    """A list in either form, ``[a, b]`` or a dash on each line; empty if not there."""
    inline = F.regexp_extract("front", rf"(?m)^{name}:[ \t]*\[(.*)\][ \t]*$", 1)
    block = F.regexp_extract("front", rf"(?m)^{name}:[ \t]*\n((?:[ \t]*-[^\n]*(?:\n|\z))+)", 1)
    dashes = F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*-[ \t]*(.*)$"), 1)
    items = F.when(inline != "", F.split(inline, ",")).otherwise(dashes)
    return F.filter(F.transform(items, _unquoted), lambda x: x != "")


def section(name: str) -> Column:
    """The text between a section's marks, without marks nested in it."""
    import re

    out = []
    for begin, end in MARKS:
        pattern = rf"(?s){re.escape(begin.format(name))}(.*?){re.escape(end.format(name))}"
        out.append(F.nullif(F.regexp_extract("body", pattern, 1), F.lit("")))
    plain = F.regexp_replace(F.coalesce(*out, F.lit("")), r"<!-- [A-Z:_]+(:BEGIN|:END) -->", "")
    return F.regexp_replace(plain, r"^\s+|\s+$", "")


def checklist(c: Column) -> Column:
    """(text, completed) of each ``- [ ]`` line; a leading ``#n`` is dropped."""
    lines = F.regexp_extract_all(c, F.lit(r"(?m)^\s*[-*]\s+(\[[ xX]\]\s+.*)$"), 1)
    return F.transform(lines, lambda x: F.struct(F.trim(F.regexp_replace(F.regexp_extract(x, r"^\[[ xX]\]\s+(.*)$", 1), r"^#\d+\s+", "")).alias("text"), F.lower(F.substring(x, 2, 1)).eqNullSafe("x").alias("completed")))


def scan_tasks(spark: SparkSession, active: str, archive: str | None = None) -> DataFrame:
    """Tasks of both folders with what hangs below them; of files with the same id the
    newest counts, and an active copy beats an archived one."""

    def one(root: str, archived: bool) -> DataFrame:
        d = split_front_matter(files(spark, root))
        t = d.select(
            scalar("id").alias("id"), scalar("title").alias("title"), F.coalesce(scalar("status"), F.lit("")).alias("status"), F.coalesce(scalar("priority"), F.lit("")).alias("priority"),
            F.coalesce(scalar("assignee"), F.lit("")).alias("assignee"), listing("labels").alias("labels"), F.coalesce(scalar("parent"), F.lit("")).alias("parent"), F.coalesce(scalar("spec"), F.lit("")).alias("spec"),
            listing("fulfills").alias("fulfills"), F.expr("try_cast(regexp_extract(front, '(?m)^order:[ \\t]*(\\\\d+)', 1) AS INT)").alias("order"),
            X.timestamp_of(scalar("createdAt")).alias("created_at"), X.timestamp_of(scalar("updatedAt")).alias("updated_at"), X.timestamp_of(scalar("completedAt")).alias("completed_at"),
            section("DESCRIPTION").alias("description"), checklist(section("AC")).alias("acceptance"), section("PLAN").alias("plan"), section("NOTES").alias("notes"), F.lit(archived).alias("archived"), "path",
        )
        return latest(t.filter("id IS NOT NULL AND id != '' AND title IS NOT NULL"), "id", "updated_at", "path")

    tasks = one(active, False)
    if archive:
        old = one(archive, True)
        tasks = tasks.unionByName(old.join(tasks.select("id"), "id", "left_anti").select(*tasks.columns))
    below = tasks.filter("parent != ''").groupBy(F.col("parent").alias("id")).agg(F.array_sort(F.collect_set("id")).alias("subtasks"))
    return tasks.join(below, "id", "left").withColumn("subtasks", F.coalesce("subtasks", F.array().cast("array<string>")))


def scan_docs(spark: SparkSession, root: str, imports: dict[str, str] | None = None) -> DataFrame:
    """Docs of a tree and of imported ones; a path is its key."""

    def one(folder: str, source: str) -> DataFrame:
        d = split_front_matter(files(spark, folder))
        return d.select("path", F.coalesce(scalar("title"), F.element_at(F.split("path", "/"), -1)).alias("title"), F.coalesce(scalar("description"), F.lit("")).alias("description"), listing("tags").alias("tags"), F.regexp_replace("body", r"^\s+|\s+$", "").alias("content"), X.timestamp_of(scalar("updatedAt")).alias("updated_at"), F.lit(source).alias("source"))

    docs = one(root, "")
    for name, folder in (imports or {}).items():
        docs = docs.unionByName(one(folder, name))
    return docs


def find_docs(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """For each wanted path the local doc, else an import of that path, else an import
    whose name is the first part of it."""
    tier = lambda key, rank, some: docs.filter(some).select(key.alias("wanted"), F.lit(rank).alias("_rank"), "path", "source", "title", "content")
    local, imported = F.col("source") == "", F.col("source") != ""
    keys = tier(F.col("path"), 0, local).unionByName(tier(F.col("path"), 1, imported)).unionByName(tier(F.concat_ws("/", "source", "path"), 2, imported))
    j = wanted.join(keys, "wanted")
    return j.groupBy("wanted").agg(F.min_by(F.struct("path", "source", "title", "content"), F.struct("_rank", "source")).alias("d")).select("wanted", "d.*")


def scan_memories(spark: SparkSession, layers: dict[str, str]) -> DataFrame:
    """Memories of each layer's folder, project first where ids are shared; which of the
    trust keys a file lacks is kept."""
    trust = ["status", "confidence", "lastVerified", "sources"]
    out = None
    for layer, root in layers.items():
        d = split_front_matter(files(spark, root, "memory-*.md"))
        lacks = F.array_compact(F.array(*[F.when(~F.col("front").rlike(rf"(?m)^{k}:"), F.lit(k)) for k in trust]))
        m = d.select(scalar("id").alias("id"), scalar("title").alias("title"), F.lit(layer).alias("layer"), F.coalesce(scalar("category"), F.lit("")).alias("category"), F.coalesce(scalar("status"), F.lit("")).alias("status"), F.coalesce(scalar("confidence"), F.lit("")).alias("confidence"), listing("sources").alias("sources"), listing("tags").alias("tags"), F.regexp_replace("body", r"^\s+|\s+$", "").alias("content"), X.timestamp_of(scalar("updatedAt")).alias("updated_at"), lacks.alias("missing_fields")).filter("id IS NOT NULL")
        out = m if out is None else out.unionByName(m)
    return out


def find_memories(wanted: DataFrame, memories: DataFrame) -> DataFrame:
    """By id, else by the slug of a title; a slug that several share finds nothing."""
    by_id = memories.select(F.col("id").alias("wanted"), F.lit(0).alias("_rank"), "id")
    slugs = memories.withColumn("wanted", X.slug("title")).groupBy("wanted").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("id")).filter("_n = 1").select("wanted", F.lit(1).alias("_rank"), "id")
    return wanted.join(by_id.unionByName(slugs), "wanted").groupBy("wanted").agg(F.min_by("id", "_rank").alias("id"))


def scan_decisions(spark: SparkSession, root: str) -> DataFrame:
    """Decisions with their four named parts."""
    from ..operators.chunking import section_of

    d = split_front_matter(files(spark, root))
    links = [listing(k).alias(v) for k, v in (("supersedes", "supersedes"), ("supersededBy", "superseded_by"), ("tags", "tags"), ("sources", "sources"), ("relatedDocs", "related_docs"), ("relatedTasks", "related_tasks"))]
    parts = [F.coalesce(section_of("body", k), F.lit("")).alias(k) for k in ("context", "decision", "alternatives", "consequences")]
    return d.select(F.coalesce(scalar("id"), F.col("path")).alias("id"), scalar("title").alias("title"), F.coalesce(scalar("status"), F.lit("draft")).alias("status"), *links, X.timestamp_of(scalar("createdAt")).alias("created_at"), *parts, F.col("body").alias("content"))


def scan_templates(spark: SparkSession, root: str) -> DataFrame:
    """Templates: name, description and the types of their actions."""
    d = files(spark, root, "*.yaml").withColumn("front", F.col("text"))
    kinds = F.regexp_extract_all("front", F.lit(r"(?m)^\s*-?\s*type:[ \t]*(\w+)"), 1)
    return d.select(F.coalesce(scalar("name"), F.element_at(F.split("path", "/"), -2)).alias("name"), F.coalesce(scalar("description"), F.lit("")).alias("description"), kinds.alias("actions"))


def visible_code(spark: SparkSession, root: str, endings: list[str], ignored: list[str], most: int | None = None) -> DataFrame:
    """Source files by ending, outside ignored folders; ``most`` files by path if asked."""
    d = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    keep = F.lower(F.element_at(F.split("path", r"\."), -1)).isin(endings)
    out = d.filter(keep & ~F.exists(F.split("path", "/"), lambda p: p.isin(ignored)))
    return out.orderBy("path").limit(most) if most else out


def entity_order() -> Column:
    return place_in("type", ["doc", "decision", "task", "memory"])
