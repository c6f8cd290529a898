"""Queries on queues, leases, debouncing and retrieval packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lexical as K
from ..operators import retrieve as R
from ..sources import adapters as A
from ..streaming import queues as S
from ..streaming import stateful as M
from ..tables import scratch
from .registry import TASKS, query
from .retrieval import DOC_CORPUS, bm25_parts


def _sessions(key: str, gap: str) -> str:
    return f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY {key} ORDER BY ts) <= INTERVAL {gap} THEN 0 ELSE 1 END AS fresh FROM events),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY {key} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)"""


@query(_sessions("user_id", "2 HOUR") + " SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS fires_at, count(*) AS events, max_by(event_type, {t: ts, v: event_type}) AS last FROM s GROUP BY user_id, n")
def debounce_sessions(spark, folder):
    e = A.table(spark, folder, "events")
    return S.debounced(e.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "event_type", "2 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("fires_at").cast("timestamp_ntz").alias("fires_at"), "events", "last")


@query(_sessions("event_type", "15 MINUTE") + " SELECT event_type, min(ts) AS since, max(ts) + INTERVAL 15 MINUTE AS expires, count(*) AS beats FROM s GROUP BY event_type, n")
def lease_sessions(spark, folder):
    e = A.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.leases(e, "event_type", "ts", "15 minutes").select("event_type", F.col("since").cast("timestamp_ntz").alias("since"), F.col("expires").cast("timestamp_ntz").alias("expires"), "beats")


@query("SELECT event_id, event_type FROM events")
def event_dedup(spark, folder):
    e = A.table(spark, folder, "events")
    return S.once(e.unionByName(e.filter("event_id % 3 = 0")), "event_id", "ts").select("event_id", "event_type")


@query("""WITH j AS (SELECT event_id, event_type, user_id % 20 AS target, ts, ts + to_milliseconds(CASE event_type WHEN 'click' THEN 1000 WHEN 'error' THEN 0 ELSE 5000 END) AS run FROM events)
  SELECT event_type AS kind, target, min_by(event_id, {t: ts, i: event_id}) AS id, max(run) AS run_after, count(*) AS requests FROM j GROUP BY 1, 2""")
def queue_coalesce(spark, folder):
    e = A.table(spark, folder, "events")
    jobs = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), (F.col("user_id") % 20).alias("target"), F.col("ts").alias("requested_at"), F.when(F.col("event_type") == "click", 1000).when(F.col("event_type") == "error", 0).otherwise(5000).alias("delay_ms"))
    return S.coalesced(jobs).select("kind", "target", "id", "run_after", "requests")


#: What a stream over the events has passed when it ends: its watermark, in milliseconds.
PASSED = "(SELECT max(epoch_us(ts)) // 1000 - 600000 FROM events)"


@query(f"""WITH j AS (SELECT event_type || '/' || (user_id % 20) AS key, CAST(event_id AS VARCHAR) AS id, epoch_us(ts) // 1000 AS t0,
    epoch_us(ts) // 1000 + CASE event_type WHEN 'click' THEN 600000 WHEN 'error' THEN 0 ELSE 3600000 END AS run FROM events WHERE epoch_us(ts) // 1000 <= {PASSED}),
  g AS (SELECT *, CASE WHEN t0 < max(run) OVER (PARTITION BY key ORDER BY t0, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM j),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY t0, id ROWS UNBOUNDED PRECEDING) AS n FROM g)
  SELECT key, min_by(id, {{t: t0, i: id}}) AS id, min(t0) AS requested_at, max(run) AS run_after, count(*) AS requests FROM s GROUP BY key, n HAVING max(run) <= {PASSED}""")
def queue_stream(spark, folder):
    """Jobs that a stream over the events has let go, by state and timers."""
    schema = A.table(spark, folder, "events").schema
    # as the file has them, times without a zone count as UTC
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    delay = F.when(F.col("event_type") == "click", 600000).when(F.col("event_type") == "error", 0).otherwise(3600000).cast("long")
    key = F.concat_ws("/", "event_type", (F.col("user_id") % 20).cast("string"))
    jobs = rows.select(key.alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").cast("string").alias("id"), delay.alias("delay_ms"))
    sink = scratch(spark, "queue-sink")
    S.to_end(M.streamed(jobs, M.Coalescing()), sink, scratch(spark, "queue-checkpoint"))
    out = spark.read.schema("key string, id string, requested_at timestamp, run_after timestamp, requests long").parquet(sink)
    return out.select("key", "id", F.unix_millis("requested_at").alias("requested_at"), F.unix_millis("run_after").alias("run_after"), "requests")


@query("""WITH b AS (SELECT event_type AS key, epoch_us(ts) // 1000 AS t0 FROM events WHERE ts <= TIMESTAMP '2024-01-20'),
  g AS (SELECT *, CASE WHEN t0 - lag(t0) OVER (PARTITION BY key ORDER BY t0) < 900000 THEN 0 ELSE 1 END AS fresh FROM b),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY t0 ROWS UNBOUNDED PRECEDING) AS n FROM g)
  SELECT key, min(t0) AS since, max(t0) + 900000 AS expires, count(*) AS beats FROM s GROUP BY key, n HAVING max(t0) + 900000 <= epoch_ms(TIMESTAMP '2024-01-20')""")
def lease_replay(spark, folder):
    """Leases that have ended by a day, replayed through the machine."""
    beats = A.table(spark, folder, "events").select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("at"))
    out = M.replayed(beats, M.Leases(900_000), "2024-01-20")
    return out.select("key", F.unix_millis("since").alias("since"), F.unix_millis("expires").alias("expires"), "beats")


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS events FROM events GROUP BY 1, 2")
def windowed_counts(spark, folder):
    e = A.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.windowed_counts(e, "event_type", "ts").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_results(spark, folder):
    return S.recent_ring(A.table(spark, folder, "events")).select("event_id", "ts")


def _pack_entities(spark, folder):
    docs = A.docs(spark, folder)
    note = F.concat("content", F.lit(" @task/"), (F.col("doc_id") % 50).cast("string"), F.lit(" @doc/"), F.lit("src1/1"))
    d = docs.select(F.lit("doc").alias("type"), F.col("path").alias("id"), "title", note.alias("content"), F.lit("").alias("lifecycle"))
    t = A.tasks(spark, folder)
    life = F.when(F.col("archived"), "archived").when(F.col("status") == "done", "done").otherwise("active")
    return d.unionByName(t.select(F.lit("task").alias("type"), F.col("key").cast("string").alias("id"), "title", F.col("description").alias("content"), life.alias("lifecycle")))


WORDS = bm25_parts(DOC_CORPUS, {"doc": K.WEIGHTS["doc"]}, "the token account")


@query(f"""WITH {WORDS[0]}, {TASKS}, res AS ({WORDS[1]} ORDER BY score DESC, title, id LIMIT 10),
  ents AS (SELECT 'doc' AS type, path AS id, title, content || ' @task/' || (doc_id % 50) || ' @doc/src1/1' AS content, '' AS life, doc_id FROM docs
    UNION ALL SELECT 'task', CAST(key AS VARCHAR), title, description, CASE WHEN archived THEN 'archived' WHEN status = 'done' THEN 'done' ELSE 'active' END, NULL FROM tasks),
  direct AS (SELECT type, id, res.score, ents.title, content, doc_id FROM res JOIN ents USING (type, id)),
  refs AS (SELECT 'task' AS type, CAST(doc_id % 50 AS VARCHAR) AS id, 'doc:' || id AS origin, score * 0.5 AS score FROM direct UNION ALL SELECT 'doc', 'src1/1', 'doc:' || id, score * 0.5 FROM direct),
  best AS (SELECT type, id, max(score) AS score, list_sort(list(DISTINCT origin)) AS origins FROM refs GROUP BY 1, 2),
  more AS (SELECT type, id, best.score, origins, title, content, life FROM best JOIN ents USING (type, id)),
  found AS (SELECT type, id, d.score, d.title, d.content, '' AS life, true AS direct, coalesce(origins, CAST([] AS VARCHAR[])) AS origins FROM direct d LEFT JOIN (SELECT type, id, origins FROM more) USING (type, id)
    UNION ALL SELECT type, id, score, title, content, life, false, origins FROM more WHERE NOT EXISTS (SELECT 1 FROM direct d WHERE d.type = more.type AND d.id = more.id))
  SELECT row_number() OVER o::INTEGER AS place, type, id, round(score, 6) AS score, direct, array_to_string(origins, ',') AS expanded_from, trim(concat_ws(chr(10) || chr(10), nullif(title, ''), nullif(content, '')), ' ') AS text
  FROM found WINDOW o AS (ORDER BY list_position(['doc', 'decision', 'task', 'memory'], type), list_position(['', 'active', 'done', 'archived'], life), score DESC, title, id) ORDER BY place LIMIT 20""")
def retrieval_pack(spark, folder):
    """Keyword results, one hop of references, in order, as a pack."""
    results = K.keyword_search(K.corpus(A.docs(spark, folder), "doc"), "the token account", 10)
    entities = _pack_entities(spark, folder)
    direct = R.candidates(results, entities)
    out = R.pack(R.merged(direct, R.expanded(direct, entities)), 20)
    return out.select("place", "citation.type", "citation.id", "score", "direct", "expanded_from", "text")
