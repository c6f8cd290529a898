"""Revisions: field differences, state at a revision, section scopes, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import tables as T

from .chunking import headings


def _previous(c: str, w) -> Column:
    return F.lag(F.col(c)).over(w)


def field_diff(states: DataFrame, fields: list[str]) -> DataFrame:
    """Rows (entity, version, field, old, new) of what changed against the revision
    before; null and empty are both unset; the first revision has no old values."""
    w = Window.partitionBy("entity").orderBy("version")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    one = lambda f: F.struct(F.lit(f).alias("field"), text(_previous(f, w)).alias("old"), text(F.col(f)).alias("new"))
    rows = states.select("entity", "version", *[one(f).alias(f"_{f}") for f in fields])
    changes = F.filter(F.array(*[F.col(f"_{f}") for f in fields]), lambda c: c["old"] != c["new"])
    return rows.select("entity", "version", F.explode(changes).alias("c")).select("entity", "version", "c.*")


def state_at(changes: DataFrame, version: int | None = None) -> DataFrame:
    """(entity, field, value) after ``version`` (None: the latest): the last change of
    each field; fields set to nothing are absent."""
    upto = changes.filter(F.col("version") <= version) if version is not None else changes
    last = upto.groupBy("entity", "field").agg(F.max_by("new", "version").alias("value"))
    return last.filter("value != ''")


def replay(changes: DataFrame, revisions: DataFrame | None = None) -> DataFrame:
    """The same for every revision (by default those that change something): each
    field's last value so far, in one window (a null is no value)."""
    versions = (changes if revisions is None else revisions).select("entity", "version").distinct()
    # a row for each version and field of an entity, which the result has too
    grid = versions.join(changes.select("entity", "field").distinct(), "entity").select("entity", "version", "field", F.lit(True).alias("_asked"), F.lit(None).cast(changes.schema["new"].dataType).alias("value"))
    rows = grid.unionByName(changes.select("entity", "version", "field", F.lit(False).alias("_asked"), F.col("new").alias("value")))
    so_far = Window.partitionBy("entity", "field").orderBy("version", "_asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("value", F.last("value", ignorenulls=True).over(so_far)).filter("_asked AND value != ''").select("entity", "version", "field", "value")


def retained(revisions: DataFrame, as_of: str, most: int | None = None, days: int | None = None) -> DataFrame:
    """Revisions that stay, by count and age; the last always does.  The first that
    stays after a removal is a checkpoint; ``removed`` says how many went before it."""
    w = Window.partitionBy("entity")
    newest = F.row_number().over(w.orderBy(F.desc("version")))
    age = F.datediff(F.lit(as_of).cast("date"), F.to_date("ts"))
    out = F.lit(False)
    if most is not None:
        out = out | (F.col("_n") > most)
    if days is not None:
        out = out | (age > days)
    r = revisions.withColumn("_n", newest).withColumn("_out", out & (F.col("_n") > 1))
    # everything before the last removed one goes too
    r = r.withColumn("_last", F.max(F.when(F.col("_out"), F.col("version"))).over(w))
    kept = r.filter(F.col("_last").isNull() | (F.col("version") > F.col("_last")))
    gone = r.filter("_last IS NOT NULL AND version <= _last").groupBy("entity").agg(F.count(F.lit(1)).alias("removed"))
    first = F.min("version").over(w) == F.col("version")
    return kept.join(gone, "entity", "left").select("entity", "version", (first & F.col("removed").isNotNull()).alias("checkpoint"), F.coalesce(F.when(first, F.col("removed")), F.lit(0)).alias("removed"))


def section_scope(old, new) -> Column:
    """The path of the one section in which two texts differ, if their outlines agree
    and only one does; null otherwise."""
    a, b = headings(old), headings(new)
    paths = lambda s: F.transform(s, lambda x: F.concat_ws(":", x["level"].cast("string"), x["path"]))
    differ = F.filter(F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: F.when(z["a"]["content"] != z["b"]["content"], z["a"]["path"])), lambda p: p.isNotNull())
    return F.when((paths(a) == paths(b)) & (F.size(differ) == 1), F.element_at(differ, 1))


def byte_delta(old, new) -> Column:
    size = lambda c: F.octet_length(F.coalesce(F.col(c), F.lit("")))
    return (size(new) - size(old)).cast("long")


def appended(revisions: DataFrame) -> DataFrame:
    """Candidate revisions that change something, numbered from 1; the first is a
    checkpoint."""
    w = Window.partitionBy("entity").orderBy("ts", "hash")
    real = revisions.withColumn("_p", F.lag("hash").over(w)).filter("_p IS NULL OR _p != hash").drop("_p")
    n = F.row_number().over(w)
    return real.withColumn("version", n).withColumn("checkpoint", n == 1)


def identities(paths: DataFrame) -> DataFrame:
    """(path, history) across renames: every path of a chain of renames (old, new) has
    the history of the last one."""
    from .graph import roots

    own = roots(paths.select(F.col("old").alias("id"), F.col("new").alias("parent"))).select(F.col("node").alias("path"), F.col("root").alias("history"))
    return own.unionByName(own.select(F.col("history").alias("path"), "history").distinct())


def path_intervals(events: DataFrame) -> DataFrame:
    """Which history each path belonged to, and when: path, starts, ends, history.

    ``events``: at, seq (their order within a time, and a name for each event), op (create,
    rename or delete), path, new_path.  A rename takes the history of a path to another one and
    frees the first; creating a path, or renaming to it, ends what was there.  So a path that is
    used again belongs to another history, and swaps and cycles of paths are told apart.  A path
    whose first event ends it has been there before (starts is null); one that is open has no
    end; renaming a path that is free begins a history.  A history is named by its first path and
    the number of the event that began it.

    Each interval of a path starts with an event and ends with the next one on that path; two are
    one history where the same rename ends the one and starts the other.  Chains of these are
    walked by doubling."""
    from .graph import roots

    rename = (F.col("op") == "rename") & (F.col("path") != F.col("new_path"))
    kept = events.filter((F.col("op") != "rename") | rename)
    into = F.struct(F.when(F.col("op") == "rename", F.col("new_path")).otherwise(F.col("path")).alias("path"), F.lit(True).alias("begins"))
    out = F.struct(F.col("path").alias("path"), F.lit(False).alias("begins"))
    sides = F.when(F.col("op") == "create", F.array(into)).when(F.col("op") == "delete", F.array(out)).otherwise(F.array(out, into))
    touch = kept.select("at", "seq", (F.col("op") == "rename").alias("moves"), F.explode(sides).alias("x")).select("at", "seq", "moves", "x.*")
    w = Window.partitionBy("path").orderBy("at", "seq")
    touch = touch.withColumns({"first": F.lag("seq").over(w).isNull(), "ends": F.lead("at").over(w), "_by": F.lead("seq").over(w), "_out": F.lead("moves").over(w) & ~F.lead("begins").over(w)})
    moved = F.when(F.col("_out"), F.col("_by"))
    own = touch.filter("begins").select("path", F.col("at").alias("starts"), "ends", F.col("seq").alias("began"), F.when(F.col("moves"), F.col("seq")).alias("from"), moved.alias("to"))
    before = touch.filter("first AND NOT begins").select("path", F.lit(None).cast(touch.schema["at"].dataType).alias("starts"), F.col("at").alias("ends"), F.lit(None).cast(touch.schema["seq"].dataType).alias("began"), F.lit(None).cast(touch.schema["seq"].dataType).alias("from"), F.when(F.col("moves"), F.col("seq")).alias("to"))
    name = F.concat("path", F.lit("#"), F.coalesce(F.col("began").cast("string"), F.lit("")))
    rows = T.stored(own.unionByName(before).withColumn("node", name), "path-intervals")
    links = rows.filter("`from` IS NOT NULL").select(F.col("node").alias("id"), F.col("from").alias("by")).join(rows.filter("`to` IS NOT NULL").select(F.col("node").alias("parent"), F.col("to").alias("by")), "by").select("id", "parent")
    found = roots(links).select(F.col("node"), F.col("root"))
    out_ = rows.join(found, "node", "left")
    return out_.select("path", "starts", "ends", F.coalesce("root", "node").alias("history"))


def history_at(wanted: DataFrame, intervals: DataFrame) -> DataFrame:
    """``wanted`` (path, at, ...) with the history that the path belonged to at that time, null
    for a path that was free or is not known: an as-of join."""
    i = intervals.select(F.col("path").alias("_path"), "starts", "ends", "history")
    within = (F.col("path") == F.col("_path")) & (F.col("starts").isNull() | (F.col("starts") <= F.col("at"))) & (F.col("ends").isNull() | (F.col("at") < F.col("ends")))
    return wanted.join(i, within, "left").drop("_path", "starts", "ends")
