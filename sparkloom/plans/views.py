"""Queries on combined search and on what pages show."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lexical as K
from ..operators import search as S
from ..operators import vector as V
from ..operators import views as W
from ..sources import adapters as A
from .maintenance import DIFF
from .registry import AUDIT, CHUNKS, DOCS, EDGES, ENTRIES, MEMORIES, TASKS, query
from .retrieval import COSINE, FUSED, MIXED_CORPUS, bm25_parts


def _vectors(spark, folder):
    c = A.chunks(spark, folder)
    return c, V.query_of(c, 0)


WORDS = bm25_parts(MIXED_CORPUS, {k: K.WEIGHTS[k] for k in ("doc", "task", "memory")}, "building order urgent")


HYBRID = f"""WITH {WORDS[0]}, kw AS (SELECT type, id AS source, score FROM ({WORDS[1]})), {COSINE.removeprefix("WITH ")},
  n AS (SELECT *, row_number() OVER (PARTITION BY type, source ORDER BY score DESC, vec_id) AS n FROM s WHERE score >= 0.3),
  rolled AS (SELECT type, source, round(sum(CASE WHEN n = 1 THEN score ELSE score * 0.1 END), 7) AS score FROM n WHERE n <= 3 GROUP BY type, source),
  a AS (SELECT type, source, row_number() OVER (ORDER BY score DESC, type, source) AS s FROM rolled), b AS (SELECT type, source, row_number() OVER (ORDER BY score DESC, type, source) AS k FROM kw),
  f AS (SELECT type, source, s, k, coalesce(1.0 / (60 + s), 0) + coalesce(1.0 / (60 + k), 0) AS raw FROM a FULL JOIN b USING (type, source)),
  g AS (SELECT type, source, round(raw / (SELECT max(raw) FROM f), 6) AS score, CASE WHEN s IS NOT NULL AND k IS NOT NULL THEN 'semantic,keyword' WHEN s IS NOT NULL THEN 'semantic' ELSE 'keyword' END AS matched_by FROM f)"""


@query(HYBRID + """
  SELECT type, source, score, matched_by, row_number() OVER (ORDER BY score DESC, type, source)::INTEGER AS place FROM g ORDER BY score DESC, type, source LIMIT 20""")
def hybrid_search(spark, folder):
    """Keyword and vector results of all kinds as one list."""
    c, q = _vectors(spark, folder)
    corpus = S.corpora(A.docs(spark, folder), A.tasks(spark, folder), A.memories(spark, folder), None, "human")
    return S.numbered(S.search(corpus, c, "building order urgent", q, "hybrid"))


def _count(text: str, most: int) -> str:
    """Words of the query in a text, each counted up to a limit."""
    return " + ".join(f"least({most}, len(list_filter(regexp_extract_all(lower({text}), '[0-9a-z_]+'), lambda x: x = '{w}')))" for w in ("building", "order", "urgent"))


@query(HYBRID + f""", e AS (SELECT 'task' AS type, id AS source, title, labels AS tags, NULL AS content, updated_at FROM tasks UNION ALL SELECT 'doc', path, title, tags, content, NULL FROM docs),
  j AS (SELECT g.*, CASE WHEN title IS NULL THEN 0 ELSE least(0.3, ({_count("title", 1000)}) * 0.03 + CASE WHEN contains(' ' || regexp_replace(lower(title), '[^0-9a-z_]', ' ', 'g') || ' ', ' building order urgent ') THEN 0.15 WHEN contains(lower(title), 'building order urgent') THEN 0.05 ELSE 0 END
    + len(list_filter(tags, lambda t: lower(t) IN ('building', 'order', 'urgent'))) * CASE WHEN type = 'doc' THEN 0.08 ELSE 0.05 END
    + CASE WHEN type = 'doc' THEN ({_count("content", 10)}) * 0.005 ELSE 0 END
    + CASE WHEN epoch_us(TIMESTAMP '1998-06-01') - epoch_us(updated_at) < 7 * 86400000000 THEN 0.05 * (1 - (epoch_us(TIMESTAMP '1998-06-01') - epoch_us(updated_at)) / 86400000000.0 / 7) ELSE 0 END)::DOUBLE END AS bonus
    FROM g LEFT JOIN e USING (type, source)),
  r AS (SELECT type, source, matched_by, score + coalesce(bonus, 0) AS raw FROM j)
  SELECT type, source, round(raw / (SELECT max(raw) FROM r), 6) AS score, matched_by FROM r ORDER BY score DESC, type, source LIMIT 20""")
def hybrid_reranked(spark, folder):
    """The hybrid list after reranking by what the tasks and docs themselves say."""
    c, q = _vectors(spark, folder)
    docs, tasks = A.docs(spark, folder), A.tasks(spark, folder)
    said = tasks.select(F.lit("task").alias("type"), F.col("id").alias("source"), "title", F.col("labels").alias("tags"), F.lit(None).cast("string").alias("content"), F.col("updated_at").cast("timestamp").alias("updated_at"))
    said = said.unionByName(docs.select(F.lit("doc").alias("type"), F.col("path").alias("source"), "title", "tags", "content", F.lit(None).cast("timestamp").alias("updated_at")))
    corpus = S.corpora(docs, tasks, A.memories(spark, folder), None, "human")
    return S.search(corpus, c, "building order urgent", q, "hybrid", entities=said, as_of="1998-06-01")


@query(FUSED.split(", kw AS")[0].rsplit(", a AS", 1)[0].replace("score >= 0.0", "score >= 0.3") + " SELECT type, source, score, 'semantic' AS matched_by FROM rolled WHERE type = 'doc' ORDER BY score DESC, type, source LIMIT 20")
def semantic_search(spark, folder):
    c, q = _vectors(spark, folder)
    return S.search(A.table(spark, folder, "documents").limit(0).selectExpr("'doc' AS type", "'' AS id", "'' AS title", "'' AS path", "'' AS category", "CAST(array() AS ARRAY<STRING>) AS tags", "'' AS f_title"), c, "part 2", q, "semantic", "doc").select("type", "source", "score", "matched_by")


@query(f"WITH {TASKS}, {MEMORIES} SELECT 'doc' AS type, count(*) AS n FROM documents WHERE lang = 'en' UNION ALL SELECT 'task', count(*) FROM tasks WHERE NOT archived AND status = 'todo' AND priority = 'high' UNION ALL SELECT 'memory', count(*) FROM memories WHERE status IN ('active', '') AND list_contains(tags, 'en')")
def filtered_corpus(spark, folder):
    """A task's status is no memory's status, so it does not filter memories."""
    c = S.corpora(A.docs(spark, folder), A.tasks(spark, folder), A.memories(spark, folder), None, "human", "en", status="todo", priority="high")
    kinds = spark.createDataFrame([("doc",), ("task",), ("memory",)], "type string")
    return kinds.join(c.groupBy("type").agg(F.count(F.lit(1)).alias("n")), "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {TASKS}, c AS (SELECT 'task' AS type, 'task-' || (vec_id * 7) AS source, vec_id AS score FROM embeddings UNION ALL SELECT 'doc', 'd' || vec_id, vec_id FROM embeddings) SELECT c.type, c.source, c.score, t.title, t.status FROM c LEFT JOIN tasks t ON c.type = 'task' AND c.source = t.id WHERE c.type != 'task' OR t.id IS NOT NULL")
def live_results(spark, folder):
    v = A.table(spark, folder, "embeddings")
    r = v.select(F.lit("task").alias("type"), F.concat(F.lit("task-"), (F.col("vec_id") * 7).cast("string")).alias("source"), F.col("vec_id").alias("score")).unionByName(v.select(F.lit("doc").alias("type"), F.concat(F.lit("d"), F.col("vec_id").cast("string")).alias("source"), F.col("vec_id").alias("score")))
    return S.live(r, A.tasks(spark, folder)).select("type", "source", "score", "title", "status")


@query(f"WITH {DOCS}, s AS (SELECT path, round(CASE WHEN contains(lower(content), 'token') THEN 0.1 ELSE 0 END + CASE WHEN contains(lower(content), 'the') THEN 0.1 ELSE 0 END, 6)::DOUBLE AS score FROM docs) SELECT path, score FROM s WHERE score > 0")
def code_scan(spark, folder):
    return S.code_scan(A.docs(spark, folder), "token the").select("path", "score")


@query(f"WITH {ENTRIES} SELECT coalesce(sum(duration) FILTER (CAST(started_at AS DATE) = DATE '1998-07-15'), 0)::BIGINT AS today, coalesce(sum(duration) FILTER (CAST(started_at AS DATE) BETWEEN DATE '1998-07-12' AND DATE '1998-07-15'), 0)::BIGINT AS week, sum(duration)::BIGINT AS total FROM entries")
def dashboard_time(spark, folder):
    return W.time_windows(A.time_entries(spark, folder), "1998-07-15")


@query(f"WITH {TASKS} SELECT id, CASE WHEN parent = '' THEN 0 ELSE 1 END AS depth, CASE WHEN parent = '' THEN id ELSE parent END AS root FROM tasks")
def task_tree(spark, folder):
    return W.task_tree(A.tasks(spark, folder)).select("id", F.col("depth").cast("int").alias("depth"), "root")


@query(f"WITH {TASKS}, {DOCS} SELECT count(*) AS synced FROM tasks WHERE status = 'done' AND spec != '' AND len(labels) > 0 AND spec IN (SELECT 'specs/' || (doc_id % 11) FROM docs)")
def spec_sync(spark, folder):
    specs = A.docs(spark, folder).select(F.concat(F.lit("specs/"), (F.col("doc_id") % 11).cast("string")).alias("path")).distinct()
    return W.synced_specs(A.tasks(spark, folder).withColumnRenamed("labels", "fulfills"), specs)


@query(f"WITH {EDGES}, e AS (SELECT DISTINCT 'incoming' AS direction, source AS node, relation FROM edges WHERE target = 'nation/4' UNION SELECT DISTINCT 'outgoing', target, relation FROM edges WHERE source = 'nation/4') SELECT direction, node, relation, upper(node) AS label, split_part(node, '/', 1) AS kind FROM e")
def node_references(spark, folder):
    e = A.edges(spark, folder)
    nodes = e.select(F.col("source").alias("node")).unionByName(e.select(F.col("target").alias("node"))).distinct()
    return W.node_references(nodes.withColumns({"label": F.upper("node"), "kind": F.split_part("node", F.lit("/"), F.lit(1))}), e, "nation/4").select("direction", "node", "relation", "label", "kind")


@query(f"WITH {MEMORIES}, i AS (SELECT id, 'proposed' AS reason FROM memories WHERE status = 'proposed' UNION ALL SELECT id, 'stale_ttl' FROM memories WHERE conv_id % 9 = 0) SELECT 'review:' || reason AS view, count(*) AS n FROM i GROUP BY reason UNION ALL SELECT 'healthy', count(*) FROM memories WHERE status IN ('active', '') AND id NOT IN (SELECT id FROM i) UNION ALL SELECT 'archived', 0 UNION ALL SELECT 'all', count(*) FROM memories")
def memory_views(spark, folder):
    m = A.memories(spark, folder)
    inbox = m.filter("status = 'proposed'").select("id", F.lit("proposed").alias("reason")).unionByName(m.filter("conv_id % 9 = 0").select("id", F.lit("stale_ttl").alias("reason")))
    return W.memory_views(m, inbox)


DECISIONS = "decisions AS (SELECT doc_id AS id, ['draft', 'accepted', 'superseded', 'rejected', 'archived'][CAST(doc_id % 5 + 1 AS INTEGER)] AS status, CASE WHEN doc_id % 3 = 0 THEN ['x'] ELSE CAST([] AS VARCHAR[]) END AS superseded_by FROM documents)"


def _decisions(spark, folder):
    d = A.table(spark, folder, "documents")
    status = F.element_at(F.array(*map(F.lit, ("draft", "accepted", "superseded", "rejected", "archived"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return d.select(F.col("doc_id").alias("id"), status.alias("status"), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("superseded_by"))


@query(f"WITH {DECISIONS} SELECT count(*) FILTER (status = 'accepted' AND len(superseded_by) = 0) AS accepted, count(*) FILTER (status = 'draft') AS draft, count(*) FILTER (status = 'superseded') AS superseded, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'archived') AS archived, count(*) AS \"all\" FROM decisions")
def decision_counts(spark, folder):
    return W.decision_counts(_decisions(spark, folder))


@query(f"WITH {DECISIONS} SELECT id FROM decisions WHERE id != 7 AND status NOT IN ('superseded', 'rejected', 'archived')")
def decision_replacements(spark, folder):
    return W.replacements(_decisions(spark, folder), 7).select("id")


@query(f"""WITH {AUDIT}, n AS (SELECT user_id, seq, ts, tool_name AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, seq DESC) AS n FROM audit), l AS (SELECT *, CASE WHEN lag(kind) OVER w = kind THEN 0 ELSE 1 END AS f FROM n WHERE n <= 30 WINDOW w AS (PARTITION BY user_id ORDER BY ts, seq)),
  r AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM l) SELECT user_id, run::BIGINT AS run, min(kind) AS kind, count(*) AS events, min(ts) AS since, max(ts) AS until FROM r GROUP BY user_id, run""")
def merged_events(spark, folder):
    a = A.audit(spark, folder).select("user_id", "seq", "ts", F.col("tool_name").alias("kind"))
    return W.merged_events(a, "user_id", 30)


@query(f"WITH {MEMORIES}, p AS (SELECT conv_id, role AS category, sum(ceil(length(content) / 4.0))::BIGINT AS tokens FROM memories GROUP BY 1, 2) SELECT conv_id, category, tokens, round(CASE WHEN sum(tokens) OVER (PARTITION BY conv_id) > 0 THEN tokens * 5000.0 / sum(tokens) OVER (PARTITION BY conv_id) ELSE 0 END, 6) AS scaled FROM p")
def token_share(spark, folder):
    m = A.memories(spark, folder).select("conv_id", F.col("role").alias("category"), F.col("content").alias("text"), F.lit(5000.0).alias("measured"))
    return W.token_share(m, "conv_id", "measured")


@query(f"WITH {MEMORIES} SELECT id, CASE WHEN turn = 0 THEN 'global' ELSE layer END AS layer FROM memories")
def promote_memories(spark, folder):
    m = A.memories(spark, folder)
    return W.moved_layer(m, m.filter("turn = 0"), "global").select("id", "layer")


@query("SELECT event_id, coalesce(['File', 'Module', 'Namespace', 'Package', 'Class', 'Method', 'Property', 'Field', 'Constructor', 'Enum', 'Interface', 'Function', 'Variable', 'Constant', 'String', 'Number', 'Boolean', 'Array', 'Object', 'Key', 'Null', 'EnumMember', 'Struct', 'Event', 'Operator', 'TypeParameter'][CAST(event_id % 30 AS INTEGER)], 'Unknown') AS kind, coalesce(['error', 'warning', 'info', 'hint'][CAST(event_id % 6 AS INTEGER)], 'unknown') AS severity FROM events")
def symbol_kinds(spark, folder):
    e = A.table(spark, folder, "events").withColumns({"k": F.col("event_id") % 30, "s": F.col("event_id") % 6})
    return e.select("event_id", W.symbol_kind("k").alias("kind"), W.severity("s").alias("severity"))


@query(f"""WITH {DIFF}, r AS (SELECT entity, field, arg_max(new, version) AS now_, coalesce(arg_max(new, version) FILTER (version <= 2), '') AS then_ FROM diff GROUP BY entity, field)
  SELECT entity, field, now_ AS old, then_ AS new FROM r WHERE now_ != then_""")
def restored_states(spark, folder):
    """The changes that bring every entity back to its second revision."""
    from ..operators.history import field_diff
    from .maintenance import _states

    return W.restored(field_diff(_states(spark, folder), ["status", "priority", "owner"]), 2)
