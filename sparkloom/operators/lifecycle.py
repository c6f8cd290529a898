"""Archive policy, status transitions, unfinished descendants and failure classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import policy_seconds
from . import graph as G
from . import refs as REFS
from . import reports as R


def _open_above(tasks: DataFrame) -> DataFrame:
    """(node, ancestor): open tasks and all tasks above them; only open ones travel."""
    open_ = tasks.filter("status != 'done' AND NOT archived").select("id")
    return G.ancestors(open_, tasks.select("id", "parent")).filter("node != ancestor")


def unfinished_descendants(tasks: DataFrame) -> DataFrame:
    """(id, descendants): descendants that are neither done nor archived, sorted."""
    return _open_above(tasks).groupBy(F.col("ancestor").alias("id")).agg(F.array_sort(F.collect_set("node")).alias("descendants"))


def archive_eligibility(tasks: DataFrame, timers: DataFrame, as_of: str, archive_after: str = "30d", automatic: bool = True, auto_archive: bool = True) -> DataFrame:
    """id, eligible and the reasons against; an archived task has one reason only."""
    now = F.lit(as_of).cast("timestamp")
    age = F.unix_micros(F.col("completed_at").cast("timestamp")) + policy_seconds(F.lit(archive_after)) * 1_000_000
    busy = timers.select(F.col("task_id").alias("id")).distinct().withColumn("_timer", F.lit(True))
    t = tasks.join(busy, "id", "left").join(_open_above(tasks).groupBy(F.col("ancestor").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("_below")), "id", "left")
    done = F.col("status") == "done"
    flags = F.array_compact(F.array(
        F.when(~done, "not_done"),
        F.when(F.lit(automatic and not auto_archive), "auto_archive_disabled"),
        F.when(F.lit(automatic) & done & F.col("completed_at").isNull(), "completed_at_missing"),
        F.when(F.lit(automatic) & done & (F.unix_micros(now) < age), "retention_pending"),
        F.when(F.coalesce("_timer", F.lit(False)), "active_timer"),
    ))
    unfinished = F.array_repeat(F.lit("unfinished_descendant"), F.coalesce("_below", F.lit(0)))
    reasons = F.when(F.col("archived"), F.array(F.lit("already_archived"))).otherwise(F.concat(flags, unfinished))
    return t.select("id", (F.size(reasons) == 0).alias("eligible"), F.array_join(reasons, ",").alias("reasons"))


def archived_batch(tasks: DataFrame, timers: DataFrame, as_of: str, execute: bool = False, archive_after: str = "30d", automatic: bool = False, auto_archive: bool = True) -> DataFrame:
    """Archiving of all tasks, as a preview or done: id, operation, eligible, changed,
    before, after, reasons, archived_at.  Done again on an archived task, it changes
    nothing but a missing time."""
    t = tasks if "archived_at" in tasks.columns else tasks.withColumn("archived_at", F.lit(None).cast("timestamp"))
    j = t.select("id", R.lifecycle_of().alias("before"), "archived", "archived_at").join(archive_eligibility(tasks, timers, as_of, archive_after, automatic, auto_archive), "id")
    goes = F.lit(execute) & (F.col("eligible") | (F.col("archived") & F.col("archived_at").isNull()))
    return j.select("id", F.lit("archive").alias("operation"), (F.col("eligible") | (F.lit(execute) & F.col("archived"))).alias("eligible"), goes.alias("changed"), "before", F.when(goes, "archived").otherwise(F.col("before")).alias("after"), "reasons", F.when(goes, F.lit(as_of).cast("timestamp")).otherwise(F.col("archived_at")).alias("archived_at"))


def reopened_batch(tasks: DataFrame, ids: DataFrame, execute: bool = False, status: str = "todo") -> DataFrame:
    """Bringing back of archived and done tasks, as a preview or done: id, operation,
    eligible, changed, before, after, status, reasons.  An id counts once."""
    new = "todo" if status.strip() in ("", "done") else status.strip()
    j = ids.select("id").distinct().join(tasks.select("id", F.col("status").alias("_status"), R.lifecycle_of().alias("before")), "id", "left")
    reason = F.when(F.col("before").isNull(), "not_found").when(F.col("before") == "active", "already_active").otherwise("")
    goes = F.lit(execute) & (reason == "")
    return j.select("id", F.lit("reopen").alias("operation"), (reason == "").alias("eligible"), goes.alias("changed"), "before", F.when(goes, "active").otherwise(F.col("before")).alias("after"), F.when(goes, new).otherwise(F.col("_status")).alias("status"), reason.alias("reasons"))


def deleted_batch(tasks: DataFrame, tombstones: DataFrame, ids: DataFrame, actor: str, reason: str, confirmed: bool, execute: bool = False) -> DataFrame:
    """Deletion for good, as a preview or done: id, operation, eligible, changed, before,
    after, reasons.  It wants a confirmation and a reason, and an id whose tombstone
    (id, actor, reason) says otherwise is not touched."""
    asked = [r for r, missing in (("confirmation_required", not confirmed), ("delete_reason_required", not reason.strip())) if missing]
    marks = tombstones.select("id", F.col("actor").alias("_actor"), F.col("reason").alias("_reason"))
    j = ids.select("id").distinct().join(tasks.select("id", R.lifecycle_of().alias("_life")), "id", "left").join(marks, "id", "left")
    marked, here = F.col("_reason").isNotNull(), F.col("_life").isNotNull()
    other = marked & ((F.col("_reason") != reason.strip()) | (F.col("_actor") != actor))
    why = F.lit(",".join(asked)) if asked else F.when(~here & ~marked, "not_found").when(other, "tombstone_conflict").when(~here, "already_deleted").otherwise("")
    able = F.lit(not asked) & ~other & (here | marked)
    goes = F.lit(execute) & able & here
    before = F.when(here | marked, F.coalesce("_life", F.lit("archived")))
    return j.select("id", F.lit("hard_delete").alias("operation"), able.alias("eligible"), goes.alias("changed"), before.alias("before"), F.when(goes, "archived").otherwise(before).alias("after"), why.alias("reasons"))


def transition(status: Column, completed_at: Column, new_status: Column, as_of: str) -> Column:
    """completed_at after a change of status: set on the way to done, cleared on the way
    out of it."""
    now = F.lit(as_of).cast("timestamp")
    return F.when((new_status == "done") & (status != "done"), now).when(new_status != "done", F.lit(None).cast("timestamp")).otherwise(completed_at)


def durable_references(tasks: DataFrame, text: str) -> DataFrame:
    """Distinct sorted references of a task to docs, decisions and memories."""
    r = REFS.references(tasks, "id", text).filter(F.col("type").isin("doc", "decision", "memory"))
    return r.groupBy(F.col("source").alias("id")).agg(F.array_sort(F.collect_set("canonical")).alias("refs"))


def counters(results: DataFrame) -> DataFrame:
    """Totals of a batch of per-row results with ``outcome``."""
    o = F.col("outcome")
    return results.agg(F.count(F.lit(1)).alias("processed"), F.count_if(o == "changed").alias("changed"), F.count_if(o == "failed").alias("failed"))


def worst_failure(failures: DataFrame) -> DataFrame:
    """Of several failures of an operation the one of highest priority."""
    return failures.groupBy("operation").agg(F.max_by("kind", F.struct("priority", "kind")).alias("kind"))
