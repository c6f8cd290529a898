"""Queries on references, graphs, validation, review, lifecycle and prompt memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph as G
from ..operators import lifecycle as L
from ..operators import memory as M
from ..operators import refs as REFS
from ..operators import review as D
from ..operators import validate as V
from ..sources import adapters as A
from .registry import AUDIT, DOCS, EDGES, MEMORIES, TASKS, query

#: A text with references for each task, so that extraction has work on the tables.
NOTED = """noted AS (SELECT key, id, 'See @task-' || (key % 20000) || ', @doc/src' || (key % 25) || '/' || (key % 1500) || '.md#top{implements} and @memory/' || (key % 90) || '-0{' || CASE WHEN key % 3 = 0 THEN 'depends' ELSE 'odd' END || '}.'
  || chr(10) || '```' || chr(10) || '@task/hidden' || chr(10) || '```' || chr(10) || '@decision/d' || (key % 4) || '!' AS note FROM tasks)"""
REF = r"(@(?:(?:doc|task|memory|decision|template)/[A-Za-z0-9_./#:\-]+|(?:task|memory)-[A-Za-z0-9_\-.]+)(?:\{[a-z\-]+\})?)"
REFS_SQL = f"""WITH {TASKS}, {NOTED}, f AS (SELECT id, regexp_extract_all(regexp_replace(note, '(?ms)^```.*?^```|^```.*\\z', '', 'g'), '{REF}') AS found FROM noted),
  e AS (SELECT id, unnest(range(0, len(found)))::INTEGER AS place, regexp_replace(unnest(found), '[\\s.,;:!?`''"]+$', '') AS raw FROM f),
  b AS (SELECT *, regexp_extract(raw, '^@([^{{]*)', 1) AS body, regexp_extract(raw, '\\{{([^}}]*)\\}}$', 1) AS rel FROM e),
  t AS (SELECT *, regexp_extract(body, '^([a-z]+)[/-]', 1) AS type, regexp_replace(body, '^[a-z]+[/-]', '') AS rest FROM b),
  g AS (SELECT *, CASE WHEN type = 'doc' THEN regexp_extract(rest, '(#.*|:\\d+-\\d+|:\\d+)$', 1) ELSE '' END AS fragment FROM t),
  refs AS (SELECT id AS source, place, raw, type, CASE WHEN fragment != '' THEN rest[1:length(rest) - length(fragment)] ELSE rest END AS target, fragment, CASE WHEN rel = '' THEN 'references' ELSE rel END AS relation,
    CASE WHEN rel = '' THEN 'references' ELSE rel END IN ('implements', 'depends', 'blocked-by', 'follows', 'related', 'parent', 'spec', 'imported-from', 'template-for', 'references') AS valid FROM g)"""


def _noted(spark, folder):
    k = F.col("key")
    s = lambda c: c.cast("string")
    note = F.concat(F.lit("See @task-"), s(k % 20000), F.lit(", @doc/src"), s(k % 25), F.lit("/"), s(k % 1500), F.lit(".md#top{implements} and @memory/"), s(k % 90), F.lit("-0{"), F.when(k % 3 == 0, "depends").otherwise("odd"), F.lit("}.\n```\n@task/hidden\n```\n@decision/d"), s(k % 4), F.lit("!"))
    return A.tasks(spark, folder).select("key", "id", note.alias("note"))


def _refs(spark, folder):
    return REFS.references(_noted(spark, folder), "id", "note")


@query(REFS_SQL + " SELECT source, place, raw, type, target, fragment, relation, valid FROM refs")
def reference_extraction(spark, folder):
    return _refs(spark, folder).select("source", "place", "raw", "type", "target", "fragment", "relation", "valid")


RESOLVED = REFS_SQL + f""", {DOCS}, {MEMORIES}, entities AS (SELECT 'task' AS type, CAST(key AS VARCHAR) AS id FROM tasks UNION SELECT 'doc', path || '.md' FROM docs UNION SELECT 'memory', id FROM memories UNION SELECT 'decision', 'd1'),
  r AS (SELECT refs.*, entities.id IS NOT NULL AS resolved FROM refs LEFT JOIN entities ON refs.type = entities.type AND refs.target = entities.id)"""


def _resolved(spark, folder):
    entity = lambda df, kind, c: df.select(F.lit(kind).alias("type"), c.alias("id"))
    found = entity(A.tasks(spark, folder), "task", F.col("key").cast("string")).unionByName(entity(A.docs(spark, folder), "doc", F.concat("path", F.lit(".md")))).unionByName(entity(A.memories(spark, folder), "memory", F.col("id"))).unionByName(entity(spark.range(1), "decision", F.lit("d1")))
    return REFS.resolve(_refs(spark, folder), found)


@query(RESOLVED + " SELECT type, resolved, count(*) AS n, count(DISTINCT target) AS targets FROM r GROUP BY 1, 2")
def reference_resolution(spark, folder):
    return _resolved(spark, folder).groupBy("type", "resolved").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("target").alias("targets"))


@query(RESOLVED + """ SELECT 'task' AS entity, source AS id, 'INVALID_SEMANTIC_REF_RELATION' AS code, 'warning' AS level FROM r WHERE NOT valid
  UNION ALL SELECT 'task', source, 'BROKEN_' || upper(type) || '_REF', 'warning' FROM r WHERE NOT resolved""")
def validate_refs(spark, folder):
    return V.validate_references(_resolved(spark, folder), "task")


@query(f"WITH {TASKS}, {NOTED} SELECT id, replace(note, '@doc/src3/53.md', '@doc/moved/here.md') AS note FROM noted")
def reference_rewrite(spark, folder):
    return _noted(spark, folder).select("id", REFS.rewrite_doc_path(F.col("note"), "src3/53.md", "moved/here.md").alias("note"))


TASK_EDGES = """te AS (SELECT id AS source, parent AS target, 'parent' AS relation, 'field' AS origin, 'task' AS target_kind FROM tasks WHERE parent != ''
  UNION ALL SELECT id, spec, 'spec', 'field', 'doc' FROM tasks WHERE spec != '' UNION ALL SELECT id, spec, 'implements', 'field', 'doc' FROM tasks WHERE spec != '')"""


@query(f"""WITH {TASKS}, {TASK_EDGES}, more AS (SELECT * FROM te UNION ALL SELECT source, target, relation, CASE WHEN length(source) % 2 = 0 THEN 'inline' ELSE 'code' END, target_kind FROM te WHERE length(target) % 2 = 0),
  n AS (SELECT *, row_number() OVER (PARTITION BY source, target, relation ORDER BY CASE origin WHEN 'field' THEN 0 WHEN 'inline' THEN 1 ELSE 2 END, origin) AS n FROM more) SELECT source, target, relation, origin, target_kind FROM n WHERE n = 1""")
def edge_dedup(spark, folder):
    e = G.task_edges(A.tasks(spark, folder))
    extra = e.filter("length(target) % 2 = 0").withColumn("origin", F.when(F.length("source") % 2 == 0, "inline").otherwise("code"))
    return G.dedup(e.unionByName(extra))


BFS = f"""WITH {EDGES.replace('edges AS (', 'edges AS MATERIALIZED (', 1)}, steps AS MATERIALIZED (SELECT source AS near, target AS far, source, target, relation FROM edges UNION ALL SELECT target, source, source, target, relation FROM edges),
  root AS (SELECT 'task/14' AS node),
  l1 AS MATERIALIZED (SELECT s.*, 1 AS depth FROM steps s JOIN root ON s.near = root.node), f1 AS MATERIALIZED (SELECT DISTINCT far AS node FROM l1 EXCEPT SELECT node FROM root),
  l2 AS MATERIALIZED (SELECT s.*, 2 AS depth FROM steps s JOIN f1 ON s.near = f1.node), s2 AS (SELECT node FROM root UNION SELECT node FROM f1), f2 AS MATERIALIZED (SELECT DISTINCT far AS node FROM l2 EXCEPT SELECT node FROM s2),
  l3 AS MATERIALIZED (SELECT s.*, 3 AS depth FROM steps s JOIN f2 ON s.near = f2.node)"""


@query(BFS + " SELECT source, target, relation, depth FROM l1 UNION ALL SELECT source, target, relation, depth FROM l2 UNION ALL SELECT source, target, relation, depth FROM l3")
def bfs_depth3(spark, folder):
    root = spark.createDataFrame([("task/14",)], "node string")
    return G.walk(A.edges(spark, folder), root, 3, "both")


@query(f"""WITH {EDGES}, u AS (SELECT source AS a, target AS b FROM edges WHERE relation = 'spec' UNION ALL SELECT target, source FROM edges WHERE relation = 'spec'), h1 AS (SELECT DISTINCT b AS node FROM u WHERE a = 'customer/3'),
  h2 AS (SELECT DISTINCT u.b AS node FROM u JOIN h1 ON u.a = h1.node WHERE u.b != 'customer/3' AND u.b NOT IN (SELECT node FROM h1))
  SELECT source, target, relation, 1 AS depth FROM edges WHERE relation = 'spec' AND target = 'customer/3'""")
def bfs_inbound_filtered(spark, folder):
    root = spark.createDataFrame([("customer/3",)], "node string")
    return G.walk(A.edges(spark, folder), root, 3, "inbound", ["spec"])


HOPS = f"""WITH RECURSIVE {EDGES}, u AS (SELECT DISTINCT * FROM (SELECT source AS a, target AS b FROM edges UNION ALL SELECT target, source FROM edges)),
  w(node, hops) AS (SELECT 'nation/4', 0 UNION SELECT u.b, hops + 1 FROM w JOIN u ON u.a = w.node WHERE hops < 3), d AS (SELECT node, min(hops) AS hops FROM w GROUP BY node)"""


@query(HOPS + " SELECT hops, count(*) AS nodes FROM d GROUP BY hops")
def khop_impact(spark, folder):
    return G.impact(A.edges(spark, folder), "nation/4", 3)


DEGREE = f"WITH {EDGES}, u AS (SELECT source AS node FROM edges UNION ALL SELECT target FROM edges), deg AS (SELECT node, count(*) AS degree FROM u GROUP BY node)"


@query(DEGREE + " SELECT node, degree FROM deg ORDER BY degree DESC, node LIMIT 300")
def degree_topn(spark, folder):
    return G.degrees(A.edges(spark, folder)).orderBy(F.desc("degree"), "node").limit(300)


@query(DEGREE + ", top AS (SELECT node FROM deg ORDER BY degree DESC, node LIMIT 300) SELECT source, target, relation FROM edges WHERE source IN (SELECT node FROM top) AND target IN (SELECT node FROM top)")
def graph_overview(spark, folder):
    return G.top_subgraph(A.edges(spark, folder), 300).select("source", "target", "relation")


@query(f"WITH {TASKS}, {TASK_EDGES}, {DOCS}, nodes AS (SELECT id AS node FROM tasks UNION SELECT 'specs/' || (doc_id % 11) FROM docs) SELECT DISTINCT source, target, relation FROM te WHERE source != target AND source IN (SELECT node FROM nodes) AND target IN (SELECT node FROM nodes)")
def knowledge_graph(spark, folder):
    t = A.tasks(spark, folder)
    nodes = t.select(F.col("id").alias("node")).unionByName(A.docs(spark, folder).select(F.concat(F.lit("specs/"), (F.col("doc_id") % 11).cast("string")).alias("node")))
    return G.knowledge_graph(nodes, G.task_edges(t))


LOOPS = "loops AS (SELECT id, CASE WHEN key % 100 = 30 THEN 'task-' || (key + 10) WHEN key % 100 = 40 THEN 'task-' || (key - 10) ELSE parent END AS parent, key FROM tasks)"


def _looped(spark, folder):
    k = F.col("key")
    name = lambda x: F.concat(F.lit("task-"), x.cast("string"))
    parent = F.when(k % 100 == 30, name(k + 10)).when(k % 100 == 40, name(k - 10)).otherwise(F.col("parent"))
    return A.tasks(spark, folder).withColumn("parent", parent)


@query(f"""WITH RECURSIVE {TASKS}, {LOOPS}, p AS (SELECT id, parent FROM loops WHERE parent != ''),
  a(node, ancestor) AS (SELECT id, parent FROM p UNION SELECT a.node, p.parent FROM a JOIN p ON a.ancestor = p.id),
  endless AS (SELECT node FROM a WHERE node = ancestor UNION SELECT node FROM a WHERE ancestor IN (SELECT node FROM a WHERE node = ancestor)) SELECT node FROM endless""")
def cycle_detect(spark, folder):
    return G.cycles(_looped(spark, folder).filter("parent != ''").select("id", "parent"))


@query(f"""WITH RECURSIVE {TASKS}, {LOOPS}, p AS (SELECT id, parent FROM loops WHERE parent != ''),
  v AS (SELECT l.id, CASE WHEN l.key % 50 = 0 THEN '' ELSE t.title END AS title, CASE WHEN l.key % 70 = 0 THEN 'paused' WHEN l.key % 90 = 0 THEN '' ELSE t.status END AS status, t.priority, CASE WHEN l.key % 30 = 6 THEN ['a', 'b', 'a'] ELSE t.labels END AS labels, l.parent, t.spec FROM loops l JOIN tasks t ON l.id = t.id),
  a(node, ancestor) AS (SELECT id, parent FROM p UNION SELECT a.node, p.parent FROM a JOIN p ON a.ancestor = p.id),
  endless AS (SELECT node FROM a WHERE node = ancestor UNION SELECT node FROM a WHERE ancestor IN (SELECT node FROM a WHERE node = ancestor))
  SELECT 'task' AS entity, id, 'TASK_NO_TITLE' AS code, 'error' AS level FROM v WHERE title = ''
  UNION ALL SELECT 'task', id, 'TASK_NO_STATUS', 'warning' FROM v WHERE status = ''
  UNION ALL SELECT 'task', id, 'TASK_INVALID_STATUS', 'warning' FROM v WHERE status = 'paused'
  UNION ALL SELECT 'task', id, 'TASK_DUPLICATE_LABELS', 'info' FROM v WHERE len(labels) != len(list_distinct(labels))
  UNION ALL SELECT 'task', id, 'BROKEN_TASK_REF', 'error' FROM v WHERE parent != '' AND parent NOT IN (SELECT id FROM v)
  UNION ALL SELECT 'task', node, 'TASK_CIRCULAR_PARENT', 'error' FROM endless
  UNION ALL SELECT 'task', id, 'BROKEN_DOC_REF', 'warning' FROM v WHERE spec != '' AND spec NOT IN ('specs/0', 'specs/4')""")
def validate_tasks(spark, folder):
    k = F.col("key")
    t = _looped(spark, folder).withColumns({"title": F.when(k % 50 == 0, "").otherwise(F.col("title")), "status": F.when(k % 70 == 0, "paused").when(k % 90 == 0, "").otherwise(F.col("status")), "labels": F.when(k % 30 == 6, F.array(*map(F.lit, "aba"))).otherwise(F.col("labels"))})
    return V.validate_tasks(t, spark.createDataFrame([("specs/0",), ("specs/4",)], "path string"))


@query(f"""WITH {MEMORIES}, {DOCS} SELECT 'memory' AS entity, id, 'MEMORY_MISSING_STATUS' AS code, 'warning' AS level FROM memories WHERE status = ''
  UNION ALL SELECT 'memory', id, 'MEMORY_CONTENT_TOO_LONG', 'warning' FROM memories WHERE length(content) > 1200
  UNION ALL SELECT 'memory', id, 'MEMORY_OLD_PROPOSED', 'warning' FROM memories WHERE status = 'proposed' AND updated_at + INTERVAL 30 DAY < TIMESTAMP '2024-04-15'
  UNION ALL SELECT 'memory', id, 'MEMORY_NO_TITLE', 'warning' FROM memories WHERE title = '' UNION ALL SELECT 'memory', id, 'MEMORY_NO_CONTENT', 'info' FROM memories WHERE trim(content, ' ') = ''
  UNION ALL SELECT 'doc', path, 'DOC_NO_TITLE', 'warning' FROM docs WHERE title = '' UNION ALL SELECT 'doc', path, 'DOC_NO_DESCRIPTION', 'info' FROM docs UNION ALL SELECT 'doc', path, 'DOC_NO_CONTENT', 'info' FROM docs WHERE trim(content, ' ') = ''""")
def validate_memories_and_docs(spark, folder):
    return V.validate_memories(A.memories(spark, folder), "2024-04-15", 1200).unionByName(V.validate_docs(A.docs(spark, folder)))


TIMERS = "timers AS (SELECT DISTINCT 'task-' || user_id AS task_id FROM events WHERE event_type = 'signup')"
OPEN = """up(node, ancestor) AS (SELECT id, parent FROM tasks WHERE parent != '' UNION SELECT up.node, t.parent FROM up JOIN tasks t ON up.ancestor = t.id WHERE t.parent != ''),
  unfinished AS (SELECT ancestor AS id, list_sort(list(DISTINCT node)) AS descendants FROM up JOIN tasks t ON up.node = t.id WHERE t.status != 'done' AND NOT t.archived AND node != ancestor GROUP BY ancestor)"""


@query(f"WITH RECURSIVE {TASKS}, {OPEN} SELECT id, array_to_string(descendants, ',') AS descendants FROM unfinished")
def unfinished_descendants(spark, folder):
    return L.unfinished_descendants(A.tasks(spark, folder)).withColumn("descendants", F.array_join("descendants", ","))


@query(f"""WITH RECURSIVE {TASKS}, {OPEN}, {TIMERS}, r AS (SELECT t.id, CASE WHEN archived THEN ['already_archived'] ELSE list_concat(list_filter([
    CASE WHEN status != 'done' THEN 'not_done' END, CASE WHEN status = 'done' AND completed_at IS NULL THEN 'completed_at_missing' END,
    CASE WHEN status = 'done' AND TIMESTAMP '2001-08-01' < completed_at + INTERVAL 30 DAY THEN 'retention_pending' END, CASE WHEN m.task_id IS NOT NULL THEN 'active_timer' END], lambda x: x IS NOT NULL),
    list_transform(coalesce(u.descendants, CAST([] AS VARCHAR[])), lambda x: 'unfinished_descendant')) END AS reasons FROM tasks t LEFT JOIN unfinished u ON t.id = u.id LEFT JOIN timers m ON t.id = m.task_id)
  SELECT id, len(reasons) = 0 AS eligible, array_to_string(reasons, ',') AS reasons FROM r""")
def archive_eligibility(spark, folder):
    timers = A.table(spark, folder, "events").filter("event_type = 'signup'").select(F.concat(F.lit("task-"), F.col("user_id").cast("string")).alias("task_id"))
    return L.archive_eligibility(A.tasks(spark, folder), timers, "2001-08-01")


@query(f"""WITH RECURSIVE {TASKS}, {OPEN}, {TIMERS}, r AS (SELECT t.id, t.archived, CASE WHEN archived THEN 'archived' WHEN status = 'done' THEN 'done' ELSE 'active' END AS before, CASE WHEN archived THEN ['already_archived'] ELSE list_concat(list_filter([
    CASE WHEN status != 'done' THEN 'not_done' END, CASE WHEN m.task_id IS NOT NULL THEN 'active_timer' END], lambda x: x IS NOT NULL),
    list_transform(coalesce(u.descendants, CAST([] AS VARCHAR[])), lambda x: 'unfinished_descendant')) END AS reasons FROM tasks t LEFT JOIN unfinished u ON t.id = u.id LEFT JOIN timers m ON t.id = m.task_id)
  SELECT id, 'archive' AS operation, archived OR len(reasons) = 0 AS eligible, archived OR len(reasons) = 0 AS changed, before, CASE WHEN archived OR len(reasons) = 0 THEN 'archived' ELSE before END AS after, array_to_string(reasons, ',') AS reasons FROM r""")
def archive_batch(spark, folder):
    """Carried out; archived tasks have no time here, which they get."""
    timers = A.table(spark, folder, "events").filter("event_type = 'signup'").select(F.concat(F.lit("task-"), F.col("user_id").cast("string")).alias("task_id"))
    return L.archived_batch(A.tasks(spark, folder), timers, "2001-08-01", execute=True).drop("archived_at")


@query(f"""WITH {TASKS}, ids AS (SELECT DISTINCT 'task-' || user_id AS id FROM events), j AS (SELECT i.id, t.status AS s, CASE WHEN archived THEN 'archived' WHEN status = 'done' THEN 'done' WHEN t.id IS NOT NULL THEN 'active' END AS before FROM ids i LEFT JOIN tasks t ON i.id = t.id)
  SELECT id, 'reopen' AS operation, before IN ('done', 'archived') AND before IS NOT NULL AS eligible, before IN ('done', 'archived') AND before IS NOT NULL AS changed, before, CASE WHEN before IN ('done', 'archived') THEN 'active' ELSE before END AS after,
    CASE WHEN before IN ('done', 'archived') THEN 'todo' ELSE s END AS status, CASE WHEN before IS NULL THEN 'not_found' WHEN before = 'active' THEN 'already_active' ELSE '' END AS reasons FROM j""")
def reopen_batch(spark, folder):
    ids = A.table(spark, folder, "events").select(F.concat(F.lit("task-"), F.col("user_id").cast("string")).alias("id"))
    return L.reopened_batch(A.tasks(spark, folder), ids, execute=True)


@query(f"""WITH {TASKS}, ids AS (SELECT DISTINCT 'task-' || user_id AS id FROM events), stones AS (SELECT DISTINCT 'task-' || user_id AS id, CASE WHEN user_id % 2 = 0 THEN 'spam' ELSE 'other' END AS reason FROM events WHERE event_type = 'error'),
  j AS (SELECT i.id, s.reason, CASE WHEN archived THEN 'archived' WHEN status = 'done' THEN 'done' WHEN t.id IS NOT NULL THEN 'active' END AS life FROM ids i LEFT JOIN tasks t ON i.id = t.id LEFT JOIN stones s ON i.id = s.id),
  k AS (SELECT *, CASE WHEN life IS NULL AND reason IS NULL THEN 'not_found' WHEN reason = 'other' THEN 'tombstone_conflict' WHEN life IS NULL THEN 'already_deleted' ELSE '' END AS why, CASE WHEN life IS NOT NULL OR reason IS NOT NULL THEN coalesce(life, 'archived') END AS before FROM j)
  SELECT id, 'hard_delete' AS operation, why IN ('', 'already_deleted') AS eligible, why = '' AS changed, before, CASE WHEN why = '' THEN 'archived' ELSE before END AS after, why AS reasons FROM k""")
def delete_batch(spark, folder):
    e = A.table(spark, folder, "events")
    name = F.concat(F.lit("task-"), F.col("user_id").cast("string")).alias("id")
    stones = e.filter("event_type = 'error'").select(name, F.lit("ops").alias("actor"), F.when(F.col("user_id") % 2 == 0, "spam").otherwise("other").alias("reason")).distinct()
    return L.deleted_batch(A.tasks(spark, folder), stones, e.select(name), "ops", "spam", confirmed=True, execute=True)


@query(f"""WITH {MEMORIES}, {TASKS}, {DOCS}, refs AS (SELECT id, unnest(['task', 'memory', 'doc', 'decision']) AS type, unnest(['task-' || conv_id, conv_id || '-' || (turn + 1), 'src' || (turn % 20) || '/' || conv_id, 'd' || (conv_id % 5)]) AS target FROM memories),
  there AS (SELECT 'task' AS type, id AS target, false AS old FROM tasks UNION ALL SELECT 'memory', id, false FROM memories UNION ALL SELECT 'doc', path, false FROM docs UNION ALL SELECT 'decision', 'd' || i, i = 2 FROM range(3) r(i)),
  j AS (SELECT r.id, t.old FROM refs r LEFT JOIN there t ON r.type = t.type AND r.target = t.target)
  SELECT 'memory' AS entity, id, CASE WHEN old IS NULL THEN 'MEMORY_BROKEN_SOURCE_REF' ELSE 'MEMORY_SOURCE_DECISION_SUPERSEDED' END AS code, 'warning' AS level FROM j WHERE old IS NULL OR old""")
def validate_memory_sources(spark, folder):
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    conv, turn = F.col("conv_id"), F.col("turn")
    m = A.memories(spark, folder).select("id", F.array(text("@task/task-", conv), text("@memory/", conv, "-", turn + 1), text("@doc/src", turn % 20, "/", conv), text("@decision/d", conv % 5, "."), F.lit("by word of mouth")).alias("sources"))
    decisions = spark.createDataFrame([("d0", "accepted", []), ("d1", "accepted", []), ("d2", "superseded", ["d1"])], "id string, status string, superseded_by array<string>")
    return V.validate_memory_sources(m, A.tasks(spark, folder), A.docs(spark, folder), decisions)


@query(f"""WITH {DOCS}, d AS (SELECT *, doc_id % 7 = 0 AS imported, doc_id % 5 = 0 AS bad FROM docs)
  SELECT 'doc' AS entity, path AS id, code, level FROM (SELECT path, unnest(CASE WHEN bad THEN ['DOC_PARSE_ERROR'] ELSE list_filter(['DOC_NO_DESCRIPTION', CASE WHEN title = '' THEN 'DOC_NO_TITLE' END, CASE WHEN trim(content, ' ') = '' THEN 'DOC_NO_CONTENT' END], lambda x: x IS NOT NULL) END) AS code FROM d WHERE NOT imported)
  JOIN (VALUES ('DOC_PARSE_ERROR', 'error'), ('DOC_NO_TITLE', 'warning'), ('DOC_NO_DESCRIPTION', 'info'), ('DOC_NO_CONTENT', 'info')) v(code, level) USING (code)""")
def validate_imported_docs(spark, folder):
    d = A.docs(spark, folder).withColumns({"imported": F.col("doc_id") % 7 == 0, "parse_error": F.when(F.col("doc_id") % 5 == 0, "unclosed fence")})
    return V.validate_docs(d)


@query(f"""WITH {DOCS}, t AS (SELECT 'tpl-' || doc_id AS id, doc_id AS k, path FROM docs)
  SELECT 'template' AS entity, id, 'TEMPLATE_NO_NAME' AS code, 'error' AS level FROM t WHERE k % 11 = 0
  UNION ALL SELECT 'template', id, 'TEMPLATE_FILE_MISSING', 'error' FROM t WHERE k % 4 = 0 UNION ALL SELECT 'template', id, 'TEMPLATE_PARSE_ERROR', 'error' FROM t WHERE k % 4 != 0 AND k % 6 = 0
  UNION ALL SELECT 'template', id, 'TEMPLATE_PATH_ERROR', 'error' FROM t WHERE k % 5 = 0 UNION ALL SELECT 'template', id, 'BROKEN_DOC_REF', 'warning' FROM t WHERE k % 3 = 0""")
def validate_templates(spark, folder):
    d, k = A.docs(spark, folder), F.col("doc_id")
    one = F.struct(F.lit("main.hbs").alias("template"), F.when(k % 5 == 0, "src/{{name").otherwise("src/{{name}}.py").alias("path"))
    name = F.concat(F.lit("tpl-"), k.cast("string")).alias("id")
    t = d.select(name, F.when(k % 11 == 0, "").otherwise("t").alias("name"), F.array(one).alias("actions"), F.when(k % 3 == 0, "gone").otherwise(F.col("path")).alias("doc"))
    files = d.filter(k % 4 != 0).select(name, F.lit("main.hbs").alias("name"), F.when(k % 6 == 0, "{{#each x}}{{y}}").otherwise("{{#if x}}{{y}}{{/if}}").alias("content"))
    return V.validate_templates(t, files, d)


NEAR = f"""WITH {MEMORIES}, s AS (SELECT id, lower(category) AS category, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS title, trim(regexp_replace(lower(content), '\\s+', ' ', 'g')) AS content,
   list_distinct(list_filter(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{Nd}}]+'), lambda t: strlen(t) >= 3)) AS a1, list_distinct(list_filter(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{Nd}}]+'), lambda t: strlen(t) >= 3)) AS a2,
   list_distinct(list_filter(regexp_extract_all(lower(title || ' ' || category || ' ' || tags[1] || ' ' || content), '[\\p{{L}}\\p{{Nd}}]+'), lambda t: strlen(t) >= 3)) AS a3 FROM memories),
  h AS (SELECT *, min(id) OVER (PARTITION BY category, title, content, list_sort(a3)) AS head FROM s),
  p AS (SELECT x.id AS a, y.id AS b, x.category = y.category AS same, x.title != '' AND x.title = y.title AS st, x.content != '' AND x.content = y.content AS sc,
   CASE WHEN len(x.a1) = 0 OR len(y.a1) = 0 THEN 0 ELSE len(list_intersect(x.a1, y.a1)) / (len(x.a1) + len(y.a1) - len(list_intersect(x.a1, y.a1)))::DOUBLE END AS j1,
   CASE WHEN len(x.a2) = 0 OR len(y.a2) = 0 THEN 0 ELSE len(list_intersect(x.a2, y.a2)) / (len(x.a2) + len(y.a2) - len(list_intersect(x.a2, y.a2)))::DOUBLE END AS j2,
   CASE WHEN len(x.a3) = 0 OR len(y.a3) = 0 THEN 0 ELSE len(list_intersect(x.a3, y.a3)) / (len(x.a3) + len(y.a3) - len(list_intersect(x.a3, y.a3)))::DOUBLE END AS j3 FROM h x JOIN h y ON x.id < y.id AND (x.id = x.head AND y.id = y.head OR x.id = y.head)),
  q AS (SELECT *, greatest(CASE WHEN st THEN 0.98 ELSE 0 END, CASE WHEN sc THEN 1.0 ELSE 0 END, j1, j2, j3) AS best FROM p),
  pairs AS (SELECT a, b, round(CASE WHEN same AND best > 0 THEN least(1.0, best + 0.05) ELSE best END, 6) AS score,
   array_to_string(list_filter([CASE WHEN st THEN 'title' END, CASE WHEN sc THEN 'content' END, CASE WHEN j1 >= 0.72 THEN 'title_tokens' END, CASE WHEN j2 >= 0.72 THEN 'content_tokens' END, CASE WHEN j3 >= 0.72 THEN 'combined' END, CASE WHEN same AND best > 0 THEN 'category' END], lambda x: x IS NOT NULL), ',') AS reasons FROM q)"""


@query(NEAR + " SELECT a, b, score, reasons FROM pairs WHERE score >= 0.72")
def near_dup_review(spark, folder):
    return D.review_pairs(A.memories(spark, folder))


EVERY = NEAR.replace(" AND (x.id = x.head AND y.id = y.head OR x.id = y.head)", "")


@query(EVERY + """, w AS (SELECT a AS id, b AS match, score FROM pairs WHERE score >= 0.72 UNION ALL SELECT b, a, score FROM pairs WHERE score >= 0.72), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, match) AS n FROM w)
  SELECT id, match, score, n FROM n WHERE n <= 5""")
def near_dup_best(spark, folder):
    return D.best_matches(A.memories(spark, folder)).select("id", "match", "score", F.col("n").cast("long").alias("n"))


@query()
def near_dup_best_of_copies(spark, folder):
    """Each memory three times: itself, a copy, and under a title that all of these share.  Pairing
    all of them is slow in SQL; the tests do it on fewer."""
    m = A.memories(spark, folder).select("id", "title", "category", "content", "tags")
    copy = m.withColumn("id", F.concat("id", F.lit("-again")))
    titled = m.withColumns({"id": F.concat("id", F.lit("-title")), "title": F.lit("one title for many"), "content": F.concat("content", F.lit(" "), "id")})
    out = D.best_matches(m.unionByName(copy).unionByName(titled))
    return out.select("id", "match", "score", F.col("n").cast("long").alias("n"))


@query(f"""WITH {DOCS}, s AS (SELECT path AS id, title, list_filter(list_distinct(list_filter(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{Nd}}]+'), lambda t: strlen(t) >= 3)), lambda t: t NOT IN ('and', 'are', 'but', 'for', 'from', 'new', 'old', 'our', 'the', 'this', 'that', 'use', 'uses', 'using', 'with')) AS t FROM docs),
  p AS (SELECT x.id AS a, y.id AS b, len(list_intersect(x.t, y.t)) AS shared FROM s x JOIN s y ON x.id < y.id AND x.title != y.title)
  SELECT a, b, shared, round(0.82 + least((shared - 2) * 0.03, 0.09), 6)::DOUBLE AS score FROM p WHERE shared >= 2""")
def conflict_topic(spark, folder):
    return D.topic_conflicts(A.docs(spark, folder).withColumn("id", F.col("path")))


@query(f"WITH {MEMORIES}, g AS (SELECT id, floor((epoch(TIMESTAMP '2024-04-01') - epoch(updated_at)) / 3600 / 24)::BIGINT AS age_days FROM memories) SELECT id, age_days FROM g WHERE age_days >= 7 ORDER BY age_days DESC, id LIMIT 20")
def cleanup_candidates(spark, folder):
    return D.cleanup_candidates(A.memories(spark, folder), "2024-04-01").select("id", "age_days")


@query(f"""WITH {MEMORIES}, i AS (SELECT id, status, updated_at, CASE WHEN turn % 3 = 0 THEN '' ELSE 'src-' || (conv_id % 40) END AS source, CASE WHEN turn % 2 = 0 THEN 45 END AS ttl_days FROM memories)
  SELECT id, 'proposed' AS reason FROM i WHERE status = 'proposed' UNION ALL SELECT id, 'stale_ttl' FROM i WHERE ttl_days IS NOT NULL AND updated_at + to_days(ttl_days) < TIMESTAMP '2024-04-01'
  UNION ALL SELECT id, 'missing_source' FROM i WHERE source = '' UNION ALL SELECT id, 'source_missing' FROM i WHERE source != '' AND source NOT IN (SELECT 'src-' || (vec_id // 15) FROM embeddings)""")
def review_inbox(spark, folder):
    m = A.memories(spark, folder).select("id", "status", "updated_at", F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit("src-"), (F.col("conv_id") % 40).cast("string"))).alias("source"), F.when(F.col("turn") % 2 == 0, 45).cast("int").alias("ttl_days"))
    return D.inbox(m, A.chunks(spark, folder).select(F.col("source").alias("id")).distinct(), "2024-04-01")


PROMPT = f"""WITH {MEMORIES}, w AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(title || ' ' || category || ' ' || content || ' ' || tags[1]), '[a-z0-9]+'), lambda t: length(t) >= 3)) AS w, (epoch_us(TIMESTAMP '2024-04-01') - epoch_us(updated_at)) / 86400000000.0 AS days FROM memories WHERE status IN ('active', '')),
  o AS (SELECT *, len(list_intersect(w, ['preference', 'that', 'the', 'under', 'was'])) AS overlap, CASE WHEN days <= 7 THEN 0.12 WHEN days <= 30 THEN 0.06 WHEN days <= 90 THEN 0.03 ELSE 0 END AS fresh FROM w),
  scored AS (SELECT id, layer, tags, updated_at, strlen(content) AS size, overlap, round(CASE layer WHEN 'project' THEN 0.12 ELSE 0.04 END + overlap * 0.35 + len(list_intersect(w, ['assistant', 'con', 'edit', 'que'])) * 0.05 + CASE WHEN list_contains(w, 'assistant') THEN 0.08 ELSE 0 END + CASE WHEN list_contains(w, 'edit') THEN 0.08 ELSE 0 END + fresh, 6)::DOUBLE AS score FROM o WHERE overlap > 0)"""


def _prompted(spark, folder):
    m = A.memories(spark, folder).filter("status IN ('active', '')")
    return M.scored(m, "the preference that was under", ["con", "que"], "assistant", "edit", "2024-04-01")


@query(PROMPT + " SELECT id, overlap, score FROM scored")
def memory_prompt_score(spark, folder):
    return _prompted(spark, folder).select("id", F.col("overlap").cast("long").alias("overlap"), "score")


@query(PROMPT + ", t AS (SELECT * FROM scored ORDER BY score DESC, updated_at DESC, id LIMIT 5) SELECT count(*) AS n, max(score) >= 0.85 AND sum(score) >= CASE WHEN count(*) = 1 THEN 1.1 ELSE 1.4 END AS inject FROM t")
def memory_injection(spark, folder):
    return M.passes_threshold(M.top(_prompted(spark, folder)))


@query(PROMPT + """, n AS (SELECT layer, id, size, 2500 - coalesce(sum(size) OVER (PARTITION BY layer ORDER BY score DESC, updated_at DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM scored)
  SELECT layer, id, least(room, size)::BIGINT AS room, size > room AS truncated FROM n WHERE room > 0""")
def memory_budget_pack(spark, folder):
    m = _prompted(spark, folder).withColumn("size", F.octet_length("content").cast("long"))
    return M.packed(m, ["layer"], [F.desc("score"), F.desc("updated_at"), F.col("id")], "size", 2500).select("layer", "id", F.col("room").cast("long").alias("room"), "truncated")


@query(f"WITH {MEMORIES} SELECT id, round(CASE layer WHEN 'project' THEN 0.2 ELSE 0.14 END + CASE WHEN (epoch_us(TIMESTAMP '2024-04-01') - epoch_us(updated_at)) <= 7 * 86400000000 THEN 0.12 WHEN (epoch_us(TIMESTAMP '2024-04-01') - epoch_us(updated_at)) <= 30 * 86400000000 THEN 0.06 WHEN (epoch_us(TIMESTAMP '2024-04-01') - epoch_us(updated_at)) <= 90 * 86400000000 THEN 0.03 ELSE 0 END, 6)::DOUBLE AS score FROM memories")
def memory_baseline(spark, folder):
    return M.baseline(A.memories(spark, folder), "2024-04-01").select("id", "score")


@query(f"WITH {MEMORIES}, c AS (SELECT id, trim(regexp_replace(lower(content), '\\s+', ' ', 'g')) AS c, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS t, layer FROM memories) SELECT DISTINCT x.id FROM c x JOIN c y ON x.id != y.id AND (x.c = y.c OR (x.layer = y.layer AND x.t = y.t AND (contains(x.c, y.c) OR contains(y.c, x.c))))")
def memory_duplicates(spark, folder):
    m = A.memories(spark, folder)
    return M.duplicate_capture(m, m)


@query(f"""WITH {MEMORIES}, p AS (SELECT id, trim(regexp_replace(lower(content), '\\s+', ' ', 'g')) AS p, regexp_extract_all(lower(content), '[a-z0-9]+') AS w FROM memories)
  SELECT id, octet_length(encode(p)) < 3 OR len(w) = 0 OR (len(w) <= 2 AND list_has_all({M.LOW_SIGNAL}, w)) AS low FROM p""")
def prompt_low_signal(spark, folder):
    return A.memories(spark, folder).select("id", M.low_signal("content").alias("low"))


@query(f"WITH {AUDIT}, v AS (SELECT DISTINCT 'nation/' || n_nationkey AS node FROM nation), {EDGES} SELECT DISTINCT node FROM v WHERE node IN (SELECT target FROM edges WHERE relation = 'parent' AND starts_with(source, 'customer/')) AND node IN (SELECT 'nation/' || c_nationkey FROM customer)")
def graph_filter(spark, folder):
    e = A.edges(spark, folder)
    nodes = e.select(F.col("source").alias("node")).unionByName(e.select(F.col("target").alias("node"))).distinct().withColumn("kind", F.split_part("node", F.lit("/"), F.lit(1)))
    return G.filtered_graph(nodes, e, ["customer", "nation"], ["parent"]).filter("kind = 'nation'").select("node")


@query(f"""WITH {MEMORIES}, {TASKS}, {DOCS}, i AS (SELECT id, CASE WHEN turn = 1 THEN 'stale' ELSE status END AS status, updated_at, CASE WHEN turn % 2 = 0 THEN 45 END AS ttl_days, conv_id % 2 = 0 AS matched,
    CASE conv_id % 6 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['@doc/src1/' || conv_id, '@task/task-' || conv_id] WHEN 2 THEN ['@decision/' || (conv_id % 90)] WHEN 3 THEN ['@decision/' || (conv_id % 90), '@doc/none', 'plain']
      WHEN 4 THEN ['@memory/' || conv_id || '-0', '@decision/' || (conv_id % 7 + 1)] ELSE ['@task/task-1'] END AS sources FROM memories),
  d AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'superseded' ELSE 'accepted' END AS status, CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey + 1 AS VARCHAR) END AS follower FROM supplier),
  e AS (SELECT id, unnest(sources) AS source, generate_subscripts(sources, 1) AS place FROM i),
  r AS (SELECT *, regexp_extract(source, '^@([a-z]+)/(.*)$', 1) AS type, regexp_extract(source, '^@([a-z]+)/(.*)$', 2) AS target FROM e),
  x AS (SELECT r.*, d.follower, CASE WHEN type = 'decision' AND d.id IS NULL OR type = 'doc' AND target NOT IN (SELECT path FROM docs) OR type = 'task' AND target NOT IN (SELECT id FROM tasks)
      OR type = 'memory' AND target NOT IN (SELECT id FROM memories) THEN 'source_missing' WHEN type = 'decision' AND (d.status = 'superseded' OR d.follower IS NOT NULL) THEN 'source_decision_superseded' END AS code
    FROM r LEFT JOIN d ON r.type = 'decision' AND d.id = r.target),
  g AS (SELECT id, list(code ORDER BY place) AS codes, string_agg(source || '>@decision/' || follower, ',' ORDER BY place) FILTER (code = 'source_decision_superseded' AND follower IS NOT NULL) AS repairs FROM x WHERE code IS NOT NULL GROUP BY id),
  o AS (SELECT i.id, list_filter([CASE WHEN status = 'proposed' THEN 'proposed' END, CASE WHEN status = 'proposed' AND matched THEN 'duplicate_review' END,
      CASE WHEN status = 'stale' OR ttl_days IS NOT NULL AND updated_at + to_days(ttl_days) < TIMESTAMP '2024-04-01' THEN 'stale_ttl' END, CASE WHEN len(sources) = 0 THEN 'missing_source' END], lambda z: z IS NOT NULL) AS own, coalesce(codes, []) AS codes, coalesce(repairs, '') AS repairs
    FROM i LEFT JOIN g ON i.id = g.id)
  SELECT id, array_to_string(own, ',') || CASE WHEN len(own) > 0 AND len(codes) > 0 THEN ',' ELSE '' END || array_to_string(list_filter(codes, lambda z, k: list_position(codes, z) = k), ',') AS reasons, repairs FROM o WHERE len(own) + len(codes) > 0""")
def review_items(spark, folder):
    """The review inbox with all six reasons and repairs."""
    c, name = F.col("conv_id"), lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    six = c % 6
    sources = F.when(six == 0, F.array().cast("array<string>")).when(six == 1, F.array(name("@doc/src1/", c), name("@task/task-", c))).when(six == 2, F.array(name("@decision/", c % 90)))
    sources = sources.when(six == 3, F.array(name("@decision/", c % 90), F.lit("@doc/none"), F.lit("plain"))).when(six == 4, F.array(F.concat(name("@memory/", c), F.lit("-0")), name("@decision/", c % 7 + 1))).otherwise(F.array(F.lit("@task/task-1")))
    m = A.memories(spark, folder)
    entries = m.select("id", F.when(F.col("turn") == 1, "stale").otherwise(F.col("status")).alias("status"), "updated_at", F.when(F.col("turn") % 2 == 0, 45).cast("int").alias("ttl_days"), sources.alias("sources"))
    kinds = [A.tasks(spark, folder).select(F.lit("task").alias("type"), "id"), A.docs(spark, folder).select(F.lit("doc").alias("type"), F.col("path").alias("id")), m.select(F.lit("memory").alias("type"), "id")]
    s = A.table(spark, folder, "supplier")
    key = F.col("s_suppkey")
    decisions = s.select(key.cast("string").alias("id"), F.when(key % 5 == 0, "superseded").otherwise("accepted").alias("status"), F.when(key % 3 == 0, F.array((key + 1).cast("string"))).otherwise(F.array().cast("array<string>")).alias("superseded_by"))
    items = D.review_items(entries, kinds[0].unionByName(kinds[1]).unionByName(kinds[2]), decisions, m.filter("conv_id % 2 = 0").select("id"), "2024-04-01")
    said = F.array_join(F.transform("repairs", lambda r: F.concat(r["source"], F.lit(">"), r["replacement"])), ",")
    return items.select("id", F.array_join("reasons", ",").alias("reasons"), said.alias("repairs"))
