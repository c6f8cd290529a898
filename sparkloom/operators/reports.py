"""Reports and list orders over tasks, time entries, audit events and memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRIORITY = ["high", "medium", "low"]
LIVE_ORDER = ["active", "done", "archived"]


def place_in(c, values: list[str]) -> Column:
    """0, 1, ... by place in ``values``; others come after all of them."""
    at = F.array_position(F.array(*map(F.lit, values)), F.col(c) if isinstance(c, str) else c)
    return F.when(at == 0, len(values)).otherwise(at - 1)


def in_window(c: str, first: str, last: str) -> Column:
    """From 00:00:00 of the first day to 23:59:59 of the last, both included."""
    end = F.lit(last).cast("timestamp") + F.expr("INTERVAL 86399 SECONDS")
    return (F.col(c) >= F.lit(first).cast("timestamp")) & (F.col(c) <= end)


def time_by_task(entries: DataFrame, tasks: DataFrame) -> DataFrame:
    """Seconds and entries of each task, summed before the join to titles."""
    sums = entries.groupBy("task_id").agg(F.sum("duration").alias("seconds"), F.count(F.lit(1)).alias("entries"))
    return sums.join(tasks.select(F.col("id").alias("task_id"), "title"), "task_id", "left").select("task_id", F.coalesce("title", F.lit("(unknown)")).alias("title"), "seconds", "entries")


def time_by_label(entries: DataFrame, tasks: DataFrame, unlabeled: str = "(no label)") -> DataFrame:
    """A task of n labels counts n times, one of none under ``unlabeled``; the grand
    total, in each row, counts every entry once."""
    per_task = entries.groupBy("task_id").agg(F.sum("duration").alias("seconds"), F.count(F.lit(1)).alias("entries"))
    labels = F.when(F.size("labels") > 0, F.col("labels")).otherwise(F.array(F.lit(unlabeled)))
    joined = per_task.join(tasks.select(F.col("id").alias("task_id"), labels.alias("labels")), "task_id", "left")
    total = per_task.agg(F.sum("seconds").alias("total_seconds"))
    by = joined.select(F.explode(F.coalesce("labels", F.array(F.lit(unlabeled)))).alias("label"), "seconds", "entries").groupBy("label").agg(F.sum("seconds").alias("seconds"), F.sum("entries").alias("entries"))
    return by.crossJoin(F.broadcast(total))


def time_by_status(entries: DataFrame, tasks: DataFrame, unknown: str = "(unknown)") -> DataFrame:
    per_task = entries.groupBy("task_id").agg(F.sum("duration").alias("seconds"))
    joined = per_task.join(tasks.select(F.col("id").alias("task_id"), "status"), "task_id", "left")
    return joined.groupBy(F.coalesce("status", F.lit(unknown)).alias("status")).agg(F.sum("seconds").alias("seconds"), F.count(F.lit(1)).alias("tasks"))


def elapsed_seconds(started: str, paused_at: str, paused_ms: str, as_of: str) -> Column:
    """Whole seconds a timer has run: without pauses, the one going on included; never
    below zero."""
    now = F.unix_millis(F.lit(as_of).cast("timestamp"))
    pause = F.when(F.col(paused_at).isNotNull(), now - F.unix_millis(F.col(paused_at).cast("timestamp"))).otherwise(0)
    run = now - F.unix_millis(F.col(started).cast("timestamp")) - F.coalesce(F.col(paused_ms), F.lit(0)) - pause
    return F.greatest(F.lit(0), F.floor(run / 1000))


def with_timers(entries: DataFrame, timers: DataFrame, as_of: str) -> DataFrame:
    """Entries and, as one more of each, the timers that run at ``as_of``."""
    running = timers.select("id", "task_id", F.col("started_at"), elapsed_seconds("started_at", "paused_at", "paused_ms", as_of).cast("long").alias("duration"))
    return entries.unionByName(running)


def board(tasks: DataFrame, statuses: list[str]) -> DataFrame:
    """Tasks of each status in the configured order; empty ones stay, unknown ones come
    last."""
    found = tasks.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    spark = tasks.sparkSession
    config = spark.createDataFrame([(s, i) for i, s in enumerate(statuses)], "status string, place int")
    return config.join(found, "status", "full").select("status", F.coalesce("place", F.lit(len(statuses))).alias("place"), F.coalesce("n", F.lit(0)).alias("tasks"))


def spec_coverage(tasks: DataFrame) -> DataFrame:
    """One row: tasks with and without a spec, distinct specs, percent to one place."""
    has = F.col("spec") != ""
    total, linked = F.count(F.lit(1)), F.count_if(has)
    return tasks.agg(total.alias("tasks"), linked.alias("with_spec"), (total - linked).alias("without_spec"), F.count_distinct(F.when(has, F.col("spec"))).alias("specs"), (F.floor(linked / total * 1000 + 0.5) / 10).alias("percent"))


def spec_progress(tasks: DataFrame) -> DataFrame:
    return tasks.filter("spec != ''").groupBy("spec").agg(F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "in-progress").alias("in_progress"))


def audit_stats(events: DataFrame) -> DataFrame:
    """Counts over all, by tool, class, result and tool with result, in one pass."""
    sets = [[], ["tool_name"], ["action_class"], ["result"], ["tool_name", "result"]]
    counts = [F.count(F.lit(1)).alias("n"), F.count_if("dry_run").alias("dry_runs"), F.sum("duration_ms").alias("total_ms")]
    return events.groupingSets(sets, "tool_name", "action_class", "result").agg(F.grouping_id().cast("int").alias("gid"), *counts)


def recent(events: DataFrame, n: int = 50, most: int = 500) -> DataFrame:
    """Newest first; at most ``most`` rows are ever returned."""
    return events.orderBy(F.desc("ts"), F.desc("seq")).limit(min(n, most))


def audit_filter(events: DataFrame, tool=None, action_class=None, result=None, since=None, until=None) -> DataFrame:
    """Equality filters and a time span that includes both ends; None: no filter."""
    for name, value in (("tool_name", tool), ("action_class", action_class), ("result", result)):
        events = events.filter(F.col(name) == value) if value else events
    events = events.filter(F.col("ts") >= F.lit(since).cast("timestamp")) if since else events
    return events.filter(F.col("ts") <= F.lit(until).cast("timestamp")) if until else events


def lifecycle_of() -> Column:
    return F.when(F.col("archived"), "archived").when(F.col("status") == "done", "done").otherwise("active")


def task_order() -> list[Column]:
    """Lifecycle, manual order with none last, id."""
    return [place_in(lifecycle_of(), LIVE_ORDER), F.col("order").asc_nulls_last(), F.col("id")]


def kanban_order() -> list[Column]:
    """Manual order first, else priority, else the newest update."""
    return [F.col("order").asc_nulls_last(), place_in("priority", PRIORITY), F.desc("updated_at"), F.col("id")]


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Rows of one page with their number: the top of the order, then the tail of it."""
    top = rows.orderBy(*order).limit(number * size)
    return top.withColumn("n", F.row_number().over(Window.orderBy(*order))).filter(F.col("n") > (number - 1) * size)


def dashboard(tasks: DataFrame) -> DataFrame:
    done = F.count_if(F.col("status") == "done")
    return tasks.agg(F.count(F.lit(1)).alias("tasks"), done.alias("done"), F.count_if(F.col("status") == "todo").alias("todo"), F.count_if(F.col("status") == "in-progress").alias("in_progress"), F.count_if((F.col("priority") == "high") & (F.col("status") != "done")).alias("high_open"), F.floor(done / F.count(F.lit(1)) * 100 + 0.5).cast("long").alias("percent"))


def week_start(c) -> Column:
    """The Sunday that starts the week of a date."""
    return F.date_sub(F.to_date(c), F.dayofweek(F.to_date(c)) - 1)


def day_histogram(tasks: DataFrame, last: str, days: int = 7) -> DataFrame:
    """Tasks created and updated on each of the last days, days of none too."""
    spark = tasks.sparkSession
    spine = spark.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(last).cast("date"), days - 1), F.lit(last).cast("date"))).alias("day"))
    count = lambda c, name: tasks.groupBy(F.to_date(c).alias("day")).agg(F.count(F.lit(1)).alias(name))
    joined = spine.join(count("created_at", "created"), "day", "left").join(count("updated_at", "updated"), "day", "left")
    return joined.select("day", F.coalesce("created", F.lit(0)).alias("created"), F.coalesce("updated", F.lit(0)).alias("updated"))


def top_labels(tasks: DataFrame, n: int = 8) -> DataFrame:
    return tasks.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("tasks")).orderBy(F.desc("tasks"), "label").limit(n)


def grouped_view(tasks: DataFrame) -> DataFrame:
    """Rank within each status by priority, then by the number in the id."""
    w = Window.partitionBy("status").orderBy(place_in("priority", PRIORITY), F.regexp_extract("id", r"(\d+)$", 1).cast("long"))
    return tasks.withColumn("rank", F.row_number().over(w))


def folder_rollup(docs: DataFrame, folder: str, sizes: str) -> DataFrame:
    """Immediate sub-folders of ``folder`` with what lies in them at any depth."""
    depth = len([p for p in folder.split("/") if p])
    inside = docs.filter(F.col("path").startswith(folder + "/")) if folder else docs
    parts = F.split("path", "/")
    below = inside.filter(F.size(parts) > depth + 1).withColumn("folder", F.array_join(F.slice(parts, 1, depth + 1), "/"))
    return below.groupBy("folder").agg(F.count(F.lit(1)).alias("docs"), F.sum(sizes).alias("total"))


def conversation_usage(turns: DataFrame) -> DataFrame:
    """By conversation: turns of each role and token estimates, the largest input and
    the sum of outputs."""
    tokens = F.ceil(F.length("content") / 4)
    by = lambda role: F.count_if(F.col("role") == role)
    return turns.groupBy("conv_id").agg(by("user").alias("user_turns"), by("assistant").alias("assistant_turns"), by("system").alias("system_turns"), F.coalesce(F.max(F.when(F.col("role") == "user", tokens)), F.lit(0)).alias("max_input_tokens"), F.coalesce(F.sum(F.when(F.col("role") == "assistant", tokens)), F.lit(0)).alias("output_tokens"))


def table_search(tasks: DataFrame, text: str, status: str | None = None) -> DataFrame:
    """Case-insensitive part of id, title, description, assignee or any label."""
    q = text.lower()
    any_ = F.exists("labels", lambda x: F.lower(x).contains(q))
    for c in ("id", "title", "description", "assignee"):
        any_ = any_ | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(q)
    return tasks.filter(any_ & (F.col("status") == status if status else F.lit(True)))


def visible_tasks(tasks: DataFrame, purpose: str, exclude_done: bool = True) -> DataFrame:
    """human: not archived; ai: active only, or not archived; historical: all."""
    if purpose == "historical":
        return tasks
    live = tasks.filter("NOT archived")
    return live.filter("status != 'done'") if purpose == "ai" and exclude_done else live


def ranking_verdicts(ranked: DataFrame, expected: DataFrame, top: int = 3) -> DataFrame:
    """Per case: pass if all expected are in the top or the first is the first expected
    one; partial if any turns up; else fail.  ranked: case_id, id, rank; expected:
    case_id, id, nth."""
    joined = expected.join(ranked, ["case_id", "id"], "left")
    per = joined.groupBy("case_id").agg(F.count(F.lit(1)).alias("wanted"), F.count_if(F.col("rank") <= top).alias("in_top"), F.count("rank").alias("found"), F.max(F.when((F.col("rank") == 1) & (F.col("nth") == 1), 1).otherwise(0)).alias("first"))
    verdict = F.when((F.col("in_top") == F.col("wanted")) | (F.col("first") == 1), "pass").when(F.col("found") > 0, "partial").otherwise("fail")
    return per.select("case_id", "wanted", "in_top", "found", verdict.alias("verdict"))
