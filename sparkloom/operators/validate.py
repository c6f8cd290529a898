"""Integrity rules, one projection each, as rows (entity, id, code, level)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph as G

#: The words that fields may hold.
STATUSES = ["todo", "in-progress", "in-review", "done", "blocked", "on-hold", "urgent"]
PRIORITIES = ["low", "medium", "high"]
MEMORY_STATUSES = ["proposed", "active", "stale", "deprecated", "archived", "rejected", "merged"]
CONFIDENCES = ["low", "medium", "high"]
LAYERS = ["project", "global"]


def _rule(df: DataFrame, entity: str, when, code: str, level: str) -> DataFrame:
    return df.filter(when).select(F.lit(entity).alias("entity"), F.col("id"), F.lit(code).alias("code"), F.lit(level).alias("level"))


def _all(rules: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), rules)


def _blank(c: str):
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def _size(c: str):
    return F.greatest(F.size(c), F.lit(0))


def _checks(df: DataFrame, entity: str, rules: list[tuple]) -> DataFrame:
    """(columns, condition, code, level) of the rules whose columns are there, in one
    pass over the rows."""
    found = [F.when(when(), F.struct(F.lit(code).alias("code"), F.lit(level).alias("level"))) for needs, when, code, level in rules if set(needs) <= set(df.columns)]
    return df.select(F.lit(entity).alias("entity"), "id", F.explode(F.array_compact(F.array(*found))).alias("_i")).select("entity", "id", "_i.code", "_i.level")


def in_scope(entity: str, scope: str = "all") -> bool:
    """Whether a scope of a validation covers an entity: all, tasks, docs, memory,
    templates, or sdd, which is tasks and docs."""
    return scope == "all" or {"task": ("tasks", "sdd"), "doc": ("docs", "sdd"), "memory": ("memory",), "template": ("templates",)}[entity].count(scope) > 0


def validate_tasks(tasks: DataFrame, docs: DataFrame, scope: str = "all") -> DataFrame:
    """acceptance (array of struct with completed) and fulfills (array) may be absent;
    missing acceptance criteria of a task with a spec count in scope sdd only."""
    ids, paths = tasks.select(F.col("id").alias("parent")), docs.select(F.col("path").alias("spec"))
    orphan = tasks.filter(~_blank("parent")).join(ids, "parent", "left_anti")
    unspecified = tasks.filter(~_blank("spec")).join(paths, "spec", "left_anti")
    loops = G.cycles(tasks.select("id", "parent")).select(F.col("node").alias("id"))
    rules = [
        (["title"], lambda: _blank("title"), "TASK_NO_TITLE", "error"),
        (["status"], lambda: _blank("status"), "TASK_NO_STATUS", "warning"),
        (["status"], lambda: ~_blank("status") & ~F.col("status").isin(STATUSES), "TASK_INVALID_STATUS", "warning"),
        (["priority"], lambda: _blank("priority"), "TASK_NO_PRIORITY", "info"),
        (["priority"], lambda: ~_blank("priority") & ~F.col("priority").isin(PRIORITIES), "TASK_INVALID_PRIORITY", "warning"),
        (["labels"], lambda: _size("labels") != F.greatest(F.size(F.array_distinct("labels")), F.lit(0)), "TASK_DUPLICATE_LABELS", "info"),
        (["fulfills", "spec"], lambda: (_size("fulfills") > 0) & _blank("spec"), "TASK_FULFILLS_NO_SPEC", "warning"),
        (["acceptance"], lambda: (F.col("status") == "done") & F.exists("acceptance", lambda x: ~x["completed"]), "TASK_DONE_UNCHECKED_AC", "warning"),
    ]
    if scope == "sdd":
        rules.append((["acceptance", "spec"], lambda: ~_blank("spec") & (_size("acceptance") == 0), "SDD_NO_AC", "warning"))
    every = F.lit(True)
    return _all([
        _checks(tasks, "task", rules),
        _rule(orphan, "task", every, "BROKEN_TASK_REF", "error"),
        _rule(tasks.join(loops, "id", "left_semi"), "task", every, "TASK_CIRCULAR_PARENT", "error"),
        _rule(unspecified, "task", every, "BROKEN_DOC_REF", "warning"),
    ])


def validate_docs(docs: DataFrame) -> DataFrame:
    """``imported`` (boolean) and ``parse_error`` (null: none) may be absent.  Imported
    docs are not looked at; of one that cannot be parsed nothing else is said."""
    d = docs.withColumn("id", F.col("path"))
    d = d.filter(~F.coalesce("imported", F.lit(False))) if "imported" in d.columns else d
    failed = F.col("parse_error").isNotNull() if "parse_error" in d.columns else F.lit(False)
    rules = [
        ([], lambda: failed, "DOC_PARSE_ERROR", "error"),
        (["title"], lambda: ~failed & _blank("title"), "DOC_NO_TITLE", "warning"),
        (["description"], lambda: ~failed & _blank("description"), "DOC_NO_DESCRIPTION", "info"),
        (["content"], lambda: ~failed & _blank("content"), "DOC_NO_CONTENT", "info"),
    ]
    return _checks(d, "doc", rules)


def validate_memories(memories: DataFrame, as_of: str, most: int = 12000, waiting_days: int = 30) -> DataFrame:
    """confidence, ttl_days, last_verified, sources, merged_into and rejected_reason may
    be absent; trust metadata (all of them but the last two, and the status) are missed
    where all its columns are there."""
    now = F.lit(as_of).cast("timestamp")
    passed = lambda c, days: F.unix_micros(F.col(c).cast("timestamp")) + days * 86_400_000_000 < F.unix_micros(now)
    trust = ["status", "confidence", "last_verified", "ttl_days", "sources"]
    rules = [
        (["title"], lambda: _blank("title"), "MEMORY_NO_TITLE", "warning"),
        (["content"], lambda: _blank("content"), "MEMORY_NO_CONTENT", "info"),
        (["layer"], lambda: ~F.col("layer").isin(LAYERS), "MEMORY_INVALID_LAYER", "error"),
        (["status"], lambda: _blank("status"), "MEMORY_MISSING_STATUS", "warning"),
        (["status"], lambda: ~_blank("status") & ~F.col("status").isin(MEMORY_STATUSES), "MEMORY_INVALID_STATUS", "warning"),
        (["confidence"], lambda: ~_blank("confidence") & ~F.col("confidence").isin(CONFIDENCES), "MEMORY_INVALID_CONFIDENCE", "warning"),
        (trust, lambda: _blank("status") | _blank("confidence") | F.col("last_verified").isNull() | (F.coalesce("ttl_days", F.lit(0)) <= 0) | (_size("sources") == 0), "MEMORY_MISSING_TRUST_METADATA", "warning"),
        (["ttl_days", "last_verified"], lambda: (F.col("ttl_days") > 0) & passed("last_verified", F.col("ttl_days")), "MEMORY_TTL_EXPIRED", "warning"),
        (["sources"], lambda: _size("sources") == 0, "MEMORY_MISSING_SOURCE", "warning"),
        (["content"], lambda: F.length("content") > most, "MEMORY_CONTENT_TOO_LONG", "warning"),
        (["status", "updated_at"], lambda: (F.col("status") == "proposed") & passed("updated_at", F.lit(waiting_days)), "MEMORY_OLD_PROPOSED", "warning"),
        (["status", "merged_into"], lambda: (F.col("status") == "merged") & _blank("merged_into"), "MEMORY_MERGED_MISSING_TARGET", "warning"),
        (["status", "rejected_reason"], lambda: (F.col("status") == "rejected") & _blank("rejected_reason"), "MEMORY_REJECTED_MISSING_REASON", "warning"),
    ]
    return _checks(memories, "memory", rules)


def validate_memory_sources(memories: DataFrame, tasks: DataFrame, docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """References among a memory's ``sources`` whose target is not there, or is a decision
    that others have superseded.  A memory may name itself; other texts are no
    references."""
    s = memories.select("id", F.explode("sources").alias("_s")).withColumn("_s", F.trim("_s"))
    s = s.select("id", F.regexp_extract("_s", r"^@(task|doc|memory|decision)[-/]", 1).alias("type"), F.rtrim(F.regexp_replace(F.regexp_replace("_s", r"^@(?:task|doc|memory|decision)[-/]", ""), r"[#{:].*$", ""), F.lit(".,;) ")).alias("target"))
    s = s.filter("type != '' AND target != ''")
    there = _all([
        tasks.select(F.lit("task").alias("type"), F.col("id").alias("target"), F.lit(False).alias("_old")),
        docs.select(F.lit("doc").alias("type"), F.col("path").alias("target"), F.lit(False).alias("_old")),
        memories.select(F.lit("memory").alias("type"), F.col("id").alias("target"), F.lit(False).alias("_old")),
        decisions.select(F.lit("decision").alias("type"), F.col("id").alias("target"), ((F.col("status") == "superseded") | (_size("superseded_by") > 0)).alias("_old")),
    ])
    j = s.join(there, ["type", "target"], "left")
    return _all([
        _rule(j, "memory", F.col("_old").isNull(), "MEMORY_BROKEN_SOURCE_REF", "warning"),
        _rule(j, "memory", F.col("_old"), "MEMORY_SOURCE_DECISION_SUPERSEDED", "warning"),
    ])


def _unbalanced(c):
    """Whether a template's double braces or its blocks do not match."""
    opened, closed = F.regexp_count(c, F.lit(r"\{\{")), F.regexp_count(c, F.lit(r"\}\}"))
    blocks = lambda mark: F.array_sort(F.regexp_extract_all(c, F.lit(r"\{\{" + mark + r"\s*(\w+)"), 1))
    return F.coalesce((opened != closed) | (blocks("#") != blocks("/")), F.lit(False))


def validate_templates(templates: DataFrame, files: DataFrame | None = None, docs: DataFrame | None = None, fix: bool = False) -> DataFrame:
    """``actions``: an array, of structs with ``template`` and ``path`` where ``files``
    (template id, name and content of what is there) is given; ``doc``: a linked doc."""
    rules = [
        (["name"], lambda: _blank("name"), "TEMPLATE_NO_NAME", "error"),
        (["actions"], lambda: _size("actions") == 0, "TEMPLATE_NO_ACTIONS", "warning"),
    ]
    out, every = [_checks(templates, "template", rules)], F.lit(True)
    if files is not None:
        steps = templates.select("id", F.explode("actions").alias("_a")).select("id", F.col("_a.template").alias("_file"), F.col("_a.path").alias("_path"))
        found = files.select(F.col("id"), F.col("name").alias("_file"), F.coalesce("content", F.lit("")).alias("_content"))
        held = steps.filter(~_blank("_file")).join(found, ["id", "_file"], "left")
        out += [
            _rule(held, "template", F.col("_content").isNull(), "TEMPLATE_FILE_MISSING", "error"),
            _rule(held, "template", _unbalanced(F.col("_content")), "TEMPLATE_PARSE_ERROR", "error"),
            _rule(steps, "template", _unbalanced(F.col("_path")), "TEMPLATE_PATH_ERROR", "error"),
        ]
    if docs is not None and "doc" in templates.columns:
        gone = templates.filter(~_blank("doc")).join(docs.select(F.col("path").alias("doc")), "doc", "left_anti")
        out.append(_rule(gone, "template", every, "BROKEN_DOC_REF", "info" if fix else "warning"))
    return _all(out)


def validate_references(refs: DataFrame, owner: str) -> DataFrame:
    """Unknown relations and targets that are not there; ``refs`` has ``resolved``."""
    broken = "warning" if owner == "task" else "info"
    r = refs.withColumn("id", F.col("source"))
    bad = _rule(r, owner, ~F.col("valid"), "INVALID_SEMANTIC_REF_RELATION", "warning")
    gone = r.filter(~F.col("resolved")).select(F.lit(owner).alias("entity"), "id", F.concat(F.lit("BROKEN_"), F.upper("type"), F.lit("_REF")).alias("code"), F.lit(broken).alias("level"))
    return bad.unionByName(gone)


def summary(issues: DataFrame, strict: bool = False) -> DataFrame:
    """Issues of each level; strict makes warnings errors."""
    level = F.when(F.lit(strict) & (F.col("level") == "warning"), "error").otherwise(F.col("level"))
    return issues.groupBy("entity", level.alias("level")).agg(F.count(F.lit(1)).alias("n"))
