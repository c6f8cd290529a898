"""Queries on lists and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import reports as R
from ..sources import adapters as A
from .registry import AUDIT, DOCS, ENTRIES, MEMORIES, TASKS, query

SPAN = "started_at >= TIMESTAMP '1998-01-01' AND started_at <= TIMESTAMP '1998-12-31' + INTERVAL 86399 SECOND"
PER_TASK = f"WITH {TASKS}, {ENTRIES}, per AS (SELECT task_id, sum(duration) AS seconds, count(*) AS entries FROM entries WHERE {SPAN} GROUP BY task_id)"
LIFE = "CASE WHEN archived THEN 'archived' WHEN status = 'done' THEN 'done' ELSE 'active' END"
LIFE_RANK = f"CASE {LIFE} WHEN 'active' THEN 0 WHEN 'done' THEN 1 ELSE 2 END"
PRIORITY_RANK = "CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END"


def _entries(spark, folder):
    return A.time_entries(spark, folder).filter(R.in_window("started_at", "1998-01-01", "1998-12-31"))


@query(PER_TASK + " SELECT p.task_id, coalesce(t.title, '(unknown)') AS title, p.seconds::BIGINT AS seconds, p.entries FROM per p LEFT JOIN tasks t ON p.task_id = t.id")
def time_report_task(spark, folder):
    return R.time_by_task(_entries(spark, folder), A.tasks(spark, folder))


@query(PER_TASK + """, l AS (SELECT unnest(CASE WHEN t.labels IS NULL OR len(t.labels) = 0 THEN ['(no label)'] ELSE t.labels END) AS label, p.seconds, p.entries FROM per p LEFT JOIN tasks t ON p.task_id = t.id)
  SELECT label, sum(seconds)::BIGINT AS seconds, sum(entries)::BIGINT AS entries, (SELECT sum(seconds) FROM per)::BIGINT AS total_seconds FROM l GROUP BY label""")
def time_report_label(spark, folder):
    return R.time_by_label(_entries(spark, folder), A.tasks(spark, folder))


@query(PER_TASK + " SELECT coalesce(t.status, '(unknown)') AS status, sum(p.seconds)::BIGINT AS seconds, count(*) AS tasks FROM per p LEFT JOIN tasks t ON p.task_id = t.id GROUP BY 1")
def time_report_status(spark, folder):
    return R.time_by_status(_entries(spark, folder), A.tasks(spark, folder))


@query(f"""WITH {ENTRIES}, timers AS (SELECT 'timer-' || event_id AS id, 'task-' || user_id AS task_id, ts AS started_at, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 HOUR END AS paused_at, event_id % 5 * 1000 AS paused_ms FROM events WHERE event_type = 'signup'),
  run AS (SELECT task_id, greatest(0, floor((epoch_us(TIMESTAMP '2024-02-01') // 1000 - epoch_us(started_at) // 1000 - paused_ms - CASE WHEN paused_at IS NULL THEN 0 ELSE epoch_us(TIMESTAMP '2024-02-01') // 1000 - epoch_us(paused_at) // 1000 END) / 1000.0))::BIGINT AS duration FROM timers),
  both_ AS (SELECT task_id, duration FROM entries UNION ALL SELECT task_id, duration FROM run)
  SELECT task_id, sum(duration)::BIGINT AS seconds, count(*) AS entries FROM both_ GROUP BY task_id""")
def time_report_with_timers(spark, folder):
    e = A.table(spark, folder, "events").filter("event_type = 'signup'")
    timers = e.select(F.concat(F.lit("timer-"), F.col("event_id").cast("string")).alias("id"), F.concat(F.lit("task-"), F.col("user_id").cast("string")).alias("task_id"), F.col("ts").alias("started_at"), F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("paused_at"), (F.col("event_id") % 5 * 1000).alias("paused_ms"))
    both = R.with_timers(A.time_entries(spark, folder), timers, "2024-02-01")
    return both.groupBy("task_id").agg(F.sum("duration").alias("seconds"), F.count(F.lit(1)).alias("entries"))


@query(f"""WITH {TASKS}, c AS (SELECT status, count(*) AS n FROM tasks GROUP BY status), k AS (SELECT unnest(['todo', 'in-review', 'done']) AS status, unnest([0, 1, 2]) AS place)
  SELECT coalesce(k.status, c.status) AS status, coalesce(k.place, 3)::INTEGER AS place, coalesce(c.n, 0) AS tasks FROM k FULL JOIN c ON k.status = c.status""")
def board_counts(spark, folder):
    return R.board(A.tasks(spark, folder), ["todo", "in-review", "done"])


@query(f"""WITH {TASKS} SELECT count(*) AS tasks, count(*) FILTER (spec != '') AS with_spec, count(*) FILTER (spec = '') AS without_spec, count(DISTINCT spec) FILTER (spec != '') AS specs,
  floor(count(*) FILTER (spec != '') / count(*)::DOUBLE * 1000 + 0.5) / 10 AS percent FROM tasks""")
def spec_coverage(spark, folder):
    return R.spec_coverage(A.tasks(spark, folder))


@query(f"WITH {TASKS} SELECT spec, count(*) AS tasks, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'in-progress') AS in_progress FROM tasks WHERE spec != '' GROUP BY spec")
def spec_progress(spark, folder):
    return R.spec_progress(A.tasks(spark, folder))


@query(f"""WITH {AUDIT} SELECT tool_name, action_class, result, grouping(tool_name, action_class, result)::INTEGER AS gid, count(*) AS n, count(*) FILTER (dry_run) AS dry_runs, sum(duration_ms)::BIGINT AS total_ms
  FROM audit GROUP BY GROUPING SETS ((), (tool_name), (action_class), (result), (tool_name, result))""")
def audit_stats_grouping_sets(spark, folder):
    return R.audit_stats(A.audit(spark, folder))


@query(f"WITH {AUDIT} SELECT tool_name, count(*) FILTER (result = 'success') AS success, count(*) FILTER (result = 'denied') AS denied, count(*) FILTER (result = 'error') AS error FROM audit GROUP BY tool_name")
def audit_matrix(spark, folder):
    a = A.audit(spark, folder)
    return a.groupBy("tool_name").pivot("result", ["success", "denied", "error"]).agg(F.count(F.lit(1))).na.fill(0)


@query(f"WITH {AUDIT} SELECT seq, ts, tool_name, result FROM audit WHERE action_class = 'write' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts DESC, seq DESC LIMIT 50")
def audit_recent(spark, folder):
    a = R.audit_filter(A.audit(spark, folder), action_class="write", since="2024-01-05", until="2024-01-20")
    return R.recent(a, 50).select("seq", "ts", "tool_name", "result")


@query(f"WITH {TASKS} SELECT id, row_number() OVER (ORDER BY {LIFE_RANK}, ord ASC NULLS LAST, id) AS n FROM tasks ORDER BY n LIMIT 100")
def task_sort_lifecycle(spark, folder):
    return R.page(A.tasks(spark, folder), R.task_order(), 1, 100).select("id", F.col("n").cast("long").alias("n"))


@query(f"WITH {TASKS} SELECT id, row_number() OVER (ORDER BY ord ASC NULLS LAST, {PRIORITY_RANK}, updated_at DESC, id) AS n FROM tasks ORDER BY n LIMIT 50")
def kanban_sort(spark, folder):
    return R.page(A.tasks(spark, folder), R.kanban_order(), 1, 50).select("id", F.col("n").cast("long").alias("n"))


@query(f"WITH {TASKS}, r AS (SELECT id, row_number() OVER (ORDER BY created_at DESC, id) AS n FROM tasks) SELECT id, n FROM r WHERE n > 40 AND n <= 60")
def page_slice(spark, folder):
    order = [F.desc("created_at"), F.col("id")]
    return R.page(A.tasks(spark, folder), order, 3, 20).select("id", F.col("n").cast("long").alias("n"))


@query(f"""WITH {TASKS} SELECT count(*) AS tasks, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'todo') AS todo, count(*) FILTER (status = 'in-progress') AS in_progress,
  count(*) FILTER (priority = 'high' AND status != 'done') AS high_open, floor(count(*) FILTER (status = 'done') / count(*)::DOUBLE * 100 + 0.5)::BIGINT AS percent FROM tasks""")
def dashboard_counts(spark, folder):
    return R.dashboard(A.tasks(spark, folder))


@query(f"""WITH {TASKS}, s AS (SELECT CAST(unnest(generate_series(DATE '1998-06-09', DATE '1998-06-15', INTERVAL 1 DAY)) AS DATE) AS day),
  c AS (SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM tasks GROUP BY 1), u AS (SELECT CAST(updated_at AS DATE) AS day, count(*) AS n FROM tasks GROUP BY 1)
  SELECT strftime(s.day, '%Y-%m-%d') AS day, coalesce(c.n, 0) AS created, coalesce(u.n, 0) AS updated FROM s LEFT JOIN c ON s.day = c.day LEFT JOIN u ON s.day = u.day""")
def dashboard_histogram(spark, folder):
    return R.day_histogram(A.tasks(spark, folder), "1998-06-15").withColumn("day", F.col("day").cast("string"))


@query(f"WITH {ENTRIES} SELECT strftime(CAST(started_at AS DATE) - CAST(dayofweek(started_at) AS INTEGER), '%Y-%m-%d') AS week, sum(duration)::BIGINT AS seconds FROM entries GROUP BY 1")
def weekly_time(spark, folder):
    return A.time_entries(spark, folder).groupBy(R.week_start("started_at").cast("string").alias("week")).agg(F.sum("duration").alias("seconds"))


@query(f"WITH {TASKS}, l AS (SELECT unnest(labels) AS label FROM tasks) SELECT label, count(*) AS tasks FROM l GROUP BY label ORDER BY tasks DESC, label LIMIT 8")
def label_topk(spark, folder):
    return R.top_labels(A.tasks(spark, folder))


@query(f"WITH {TASKS} SELECT id, status, row_number() OVER (PARTITION BY status ORDER BY {PRIORITY_RANK}, key) AS rank FROM tasks")
def grouped_task_view(spark, folder):
    return R.grouped_view(A.tasks(spark, folder)).select("id", "status", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {DOCS} SELECT split_part(path, '/', 1) AS folder, count(*) AS docs, sum(length(content))::BIGINT AS total FROM docs GROUP BY 1")
def folder_rollup(spark, folder):
    return R.folder_rollup(A.docs(spark, folder).withColumn("size", F.length("content")), "", "size")


@query(f"""WITH {MEMORIES} SELECT conv_id, count(*) FILTER (role = 'user') AS user_turns, count(*) FILTER (role = 'assistant') AS assistant_turns, count(*) FILTER (role = 'system') AS system_turns,
  coalesce(max(CASE WHEN role = 'user' THEN ceil(length(content) / 4.0) END), 0)::BIGINT AS max_input_tokens, coalesce(sum(CASE WHEN role = 'assistant' THEN ceil(length(content) / 4.0) END), 0)::BIGINT AS output_tokens FROM memories GROUP BY conv_id""")
def conversation_usage(spark, folder):
    return R.conversation_usage(A.memories(spark, folder))


@query(f"WITH {TASKS} SELECT id, status FROM tasks WHERE status = 'todo' AND (contains(lower(id), '#00000012') OR contains(lower(title), '#00000012') OR contains(lower(description), '#00000012') OR contains(lower(assignee), '#00000012') OR len(list_filter(labels, lambda x: contains(lower(x), '#00000012'))) > 0)")
def task_table_search(spark, folder):
    return R.table_search(A.tasks(spark, folder), "#00000012", "todo").select("id", "status")


@query(f"WITH {TASKS} SELECT 'human' AS purpose, count(*) FILTER (NOT archived) AS tasks FROM tasks UNION ALL SELECT 'ai', count(*) FILTER (NOT archived AND status != 'done') FROM tasks UNION ALL SELECT 'historical', count(*) FROM tasks")
def task_visibility(spark, folder):
    t = A.tasks(spark, folder)
    one = lambda p: R.visible_tasks(t, p).agg(F.lit(p).alias("purpose"), F.count(F.lit(1)).alias("tasks")).select("purpose", "tasks")
    return one("human").unionByName(one("ai")).unionByName(one("historical"))


@query(f"""WITH {TASKS} SELECT id, assignee, priority FROM tasks WHERE NOT archived AND status = 'in-progress' AND priority = 'high' AND list_contains(labels, 'building')""")
def task_filters(spark, folder):
    t = A.tasks(spark, folder).filter("NOT archived").filter((F.col("status") == "in-progress") & (F.col("priority") == "high") & F.array_contains("labels", "building"))
    return t.select("id", "assignee", "priority")


@query(f"""WITH {AUDIT}, r AS (SELECT user_id AS case_id, tool_name AS id, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, tool_name) AS rank FROM (SELECT user_id, tool_name, count(*) AS n FROM audit WHERE result = 'success' GROUP BY 1, 2)),
  x AS (SELECT DISTINCT user_id AS case_id, unnest(['click', 'view']) AS id, unnest([1, 2]) AS nth FROM audit),
  p AS (SELECT x.case_id, count(*) AS wanted, count(*) FILTER (rank <= 1) AS in_top, count(rank) AS found, max(CASE WHEN rank = 1 AND nth = 1 THEN 1 ELSE 0 END) AS first FROM x LEFT JOIN r ON x.case_id = r.case_id AND x.id = r.id GROUP BY 1)
  SELECT case_id, wanted, in_top, found, CASE WHEN in_top = wanted OR first = 1 THEN 'pass' WHEN found > 0 THEN 'partial' ELSE 'fail' END AS verdict FROM p""")
def ranking_benchmark(spark, folder):
    a = A.audit(spark, folder)
    counts = a.filter("result = 'success'").groupBy(F.col("user_id").alias("case_id"), F.col("tool_name").alias("id")).count()
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("count"), "id"))).drop("count")
    expected = a.select(F.col("user_id").alias("case_id")).distinct().select("case_id", F.posexplode(F.array(F.lit("click"), F.lit("view"))).alias("p", "id")).select("case_id", "id", (F.col("p") + 1).alias("nth"))
    return R.ranking_verdicts(ranked, expected, 1)


@query(f"WITH {MEMORIES} SELECT layer, category, count(*) AS n FROM memories GROUP BY GROUPING SETS ((layer, category), (layer), ())")
def knowledge_counts(spark, folder):
    m = A.memories(spark, folder)
    return m.groupingSets([["layer", "category"], ["layer"], []], "layer", "category").agg(F.count(F.lit(1)).alias("n"))
