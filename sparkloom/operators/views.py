"""What pages and lists show: progress, references of a node, counts by filter, merged
events, trees, help."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph as G

#: Names of symbol kinds 1 to 26.
SYMBOL_KINDS = ["File", "Module", "Namespace", "Package", "Class", "Method", "Property", "Field", "Constructor", "Enum", "Interface", "Function", "Variable", "Constant", "String", "Number", "Boolean", "Array", "Object", "Key", "Null", "EnumMember", "Struct", "Event", "Operator", "TypeParameter"]
SEVERITIES = ["error", "warning", "info", "hint"]


def symbol_kind(code) -> Column:
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, SYMBOL_KINDS)), F.when(F.col(code).between(1, 26), F.col(code)).otherwise(27).cast("int")), F.lit("Unknown"))


def severity(code) -> Column:
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, SEVERITIES)), F.when(F.col(code).between(1, 4), F.col(code)).otherwise(5).cast("int")), F.lit("unknown"))


def criteria_progress(c: str) -> Column:
    """(total, completed) of the boxes under the heading of acceptance criteria."""
    part = F.regexp_extract(F.coalesce(F.col(c), F.lit("")), r"(?is)##\s*Acceptance Criteria[ \t]*\n(.*?)(?=\n##\s|\n---|\z)", 1)
    done, open_ = F.regexp_count(part, F.lit(r"- \[[xX]\]")), F.regexp_count(part, F.lit(r"- \[ \]"))
    return F.struct((done + open_).alias("total"), done.alias("completed"))


def is_spec(path: str, tags: str) -> Column:
    return F.col(path).startswith("specs/") | F.array_contains(tags, "spec")


def node_references(nodes: DataFrame, edges: DataFrame, selected: str) -> DataFrame:
    """What points at a node and what it points at, each once, by label."""
    side = lambda here, there, name: edges.filter(F.col(here) == selected).select(F.lit(name).alias("direction"), F.col(there).alias("node"), "relation")
    both = side("target", "source", "incoming").unionByName(side("source", "target", "outgoing")).distinct()
    return both.join(nodes.select("node", "label", "kind"), "node").orderBy("direction", "label", "node")


def synced_specs(tasks: DataFrame, docs: DataFrame) -> DataFrame:
    """How many done tasks fulfil something of a spec that is there."""
    t = tasks.filter((F.col("status") == "done") & (F.col("spec") != "") & (F.size("fulfills") > 0))
    return t.join(docs.select(F.col("path").alias("spec")), "spec", "left_semi").agg(F.count(F.lit(1)).alias("synced"))


def time_windows(entries: DataFrame, now: str) -> DataFrame:
    """Seconds of today, of the week since Sunday and of all time, in one pass."""
    day = F.lit(now).cast("date")
    sunday = F.date_sub(day, F.dayofweek(day) - 1)
    on = F.to_date("started_at")
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("duration"))), F.lit(0))
    return entries.agg(total(on == day).alias("today"), total((on >= sunday) & (on <= day)).alias("week"), total(F.lit(True)).alias("total"))


def task_tree(tasks: DataFrame) -> DataFrame:
    """id, depth and root of every task under its parents; roots, and tasks whose chain
    of parents never ends, have depth 0 and are their own root."""
    top = G.roots(tasks.select("id", "parent")).withColumnRenamed("node", "id")
    return tasks.select("id").join(top, "id", "left").select("id", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("root", "id").alias("root"))


def memory_views(memories: DataFrame, inbox: DataFrame) -> DataFrame:
    """Rows of each view: by reason of review, healthy, archived, all."""
    live = memories.filter(F.coalesce(F.nullif("status", F.lit("")), F.lit("active")) == "active").join(inbox.select("id"), "id", "left_anti")
    count = lambda df, name: df.agg(F.lit(name).alias("view"), F.count(F.lit(1)).alias("n")).select("view", "n")
    reasons = inbox.groupBy(F.concat(F.lit("review:"), "reason").alias("view")).agg(F.count(F.lit(1)).alias("n"))
    return reasons.unionByName(count(live, "healthy")).unionByName(count(memories.filter("status = 'archived'"), "archived")).unionByName(count(memories, "all"))


def decision_counts(decisions: DataFrame) -> DataFrame:
    """Decisions of each filter; accepted ones count while they are current."""
    current = (F.col("status") == "accepted") & (F.size("superseded_by") == 0)
    by = [F.count_if(F.col("status") == s).alias(s) for s in ("draft", "superseded", "rejected", "archived")]
    return decisions.agg(F.count_if(current).alias("accepted"), *by, F.count(F.lit(1)).alias("all"))


def replacements(decisions: DataFrame, selected: str) -> DataFrame:
    return decisions.filter((F.col("id") != selected) & ~F.col("status").isin("superseded", "rejected", "archived"))


def merged_events(events: DataFrame, group: str, last: int) -> DataFrame:
    """The last events of each group, neighbours of the same kind as one."""
    w = Window.partitionBy(group)
    some = events.withColumn("_n", F.row_number().over(w.orderBy(F.desc("ts"), F.desc("seq")))).filter(F.col("_n") <= last)
    order = w.orderBy("ts", "seq")
    fresh = F.when(F.lag("kind").over(order) == F.col("kind"), 0).otherwise(1)
    run = some.withColumn("_f", fresh).withColumn("run", F.sum("_f").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(group, "run").agg(F.first("kind").alias("kind"), F.count(F.lit(1)).alias("events"), F.min("ts").alias("since"), F.max("ts").alias("until"))


def token_share(parts: DataFrame, group: str, measured: str) -> DataFrame:
    """Token estimates of each category of a group, scaled to the measured total."""
    own = parts.groupBy(group, "category").agg(F.sum(F.ceil(F.length("text") / 4)).alias("tokens"), F.max(measured).alias("_m"))
    total = F.sum("tokens").over(Window.partitionBy(group))
    return own.select(group, "category", "tokens", F.round(F.when(total > 0, F.col("tokens") * F.col("_m") / total).otherwise(0.0), 6).alias("scaled"))


def help_matches(entries: DataFrame, query: str, most: int = 5) -> DataFrame:
    """Keys for a query: the exact one, else those with a prefix (``a.*``), else those
    whose text contains it; at most ``most`` suggestions if none does."""
    q = query.lower()
    text = F.lower(F.concat_ws(" ", "key", "text"))
    rank = F.when(F.col("key") == query, 0)
    rank = rank.when(F.col("key").startswith(query[:-1]), 1) if query.endswith(".*") else rank.when(text.contains(q), 1)
    hits = entries.withColumn("_r", rank).filter("_r IS NOT NULL")
    exact = hits.filter("_r = 0").limit(1).isEmpty()
    found = hits.filter(F.lit(exact) | (F.col("_r") == 0)).select("key")
    if not found.limit(1).isEmpty():
        return found.orderBy("key")
    return entries.select("key").orderBy("key").limit(most)


def moved_layer(memories: DataFrame, ids: DataFrame, layer: str) -> DataFrame:
    """Memories with the named ones in another layer (promotion and demotion)."""
    there = ids.select("id").distinct().withColumn("_move", F.lit(True))
    return memories.join(there, "id", "left").withColumn("layer", F.when(F.col("_move"), layer).otherwise(F.col("layer"))).drop("_move")


def restored(changes: DataFrame, version: int) -> DataFrame:
    """The changes of a new revision that brings every entity back to ``version``."""
    from .history import state_at

    then = state_at(changes, version).withColumnRenamed("value", "new")
    now = state_at(changes).withColumnRenamed("value", "old")
    both = now.join(then, ["entity", "field"], "full").select("entity", "field", F.coalesce("old", F.lit("")).alias("old"), F.coalesce("new", F.lit("")).alias("new"))
    return both.filter("old != new")


def looks_like_task_id(c: str) -> Column:
    return F.col(c).rlike(r"^[0-9A-Za-z-]{0,20}$")


def _blanked(c: Column, pattern: str) -> Column:
    """What matches becomes as many blanks, so that columns stay."""
    parts = F.regexp_extract_all(c, F.lit(f"({pattern})"), 1)
    return F.aggregate(parts, c, lambda a, q: F.replace(a, q, F.repeat(F.lit(" "), F.length(q))))


def first_symbol(lines: DataFrame, name: str) -> DataFrame:
    """The first line of each file on which ``name`` stands outside comments and
    strings, and its column in UTF-16 units.  lines: path, number, text."""
    import re

    w = Window.partitionBy("path").orderBy("number")
    code = _blanked(F.col("text"), r'"(?:[^"\\]|\\.)*"')
    opens = F.regexp_count(code, F.lit(r"/\*")) - F.regexp_count(code, F.lit(r"\*/"))
    rows = lines.withColumns({"_code": code, "_opens": opens})
    inside = F.coalesce(F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0
    rows = rows.withColumn("_in", inside)
    c = F.col("_code")
    c = F.when(F.col("_in") & ~c.contains("*/"), "").when(F.col("_in"), _blanked(c, r"^.*?\*/")).otherwise(c)
    c = _blanked(_blanked(_blanked(c, r"/\*.*?\*/"), r"//.*$"), r"/\*.*$")
    pattern = rf"(?<![0-9A-Za-z_]){re.escape(name)}(?![0-9A-Za-z_])"
    hit = rows.withColumn("_code", c).filter(F.col("_code").rlike(pattern))
    before = F.regexp_extract("_code", rf"^(.*?){pattern}", 1)
    wide = F.length(F.regexp_replace(before, r"[^\x{10000}-\x{10FFFF}]", ""))
    at = hit.withColumn("column", F.length(before) + wide)
    return at.groupBy("path").agg(F.min_by(F.struct("number", "column"), "number").alias("at")).select("path", "at.*")
