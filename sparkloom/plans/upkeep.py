"""Queries on upkeep by epochs: commits that check hashes, and reindexing by changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking as C
from ..operators import index as I
from ..sources import adapters as A
from ..streaming.upkeep import Upkeep
from ..tables import scratch
from .registry import DOCS, query

SEEN = "CASE event_id % 4 WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'signup' END"


@query(f"""WITH c AS (SELECT 'u' || user_id AS source, {{'seq': event_id, 'expected': {SEEN}, 'hash': nullif(event_type, 'error'), 'won': 0}} AS c FROM events),
  l AS (SELECT source, list_prepend({{'seq': CAST(NULL AS BIGINT), 'expected': CAST(NULL AS VARCHAR), 'hash': CAST(NULL AS VARCHAR), 'won': 0}}, list(c ORDER BY c.seq)) AS l FROM c GROUP BY source),
  f AS (SELECT source, len(l) - 1 AS n, list_reduce(l, lambda a, x: CASE WHEN a.hash IS NOT DISTINCT FROM x.expected THEN {{'seq': x.seq, 'expected': x.expected, 'hash': x.hash, 'won': a.won + 1}} ELSE a END) AS f FROM l)
  SELECT source, f.hash AS hash, f.seq AS seq, CAST(n - f.won AS BIGINT) AS lost FROM f""")
def upkeep_commits(spark, folder):
    """Events as writers that have read one state and write another, committed by a stream."""
    schema = A.table(spark, folder, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    seen = F.when(F.col("event_id") % 4 == 0, "view").when(F.col("event_id") % 4 == 1, "click").when(F.col("event_id") % 4 == 2, "signup")
    changes = rows.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"), F.col("event_id").alias("seq"), seen.alias("expected"), F.nullif("event_type", F.lit("error")).alias("hash"))
    kept = Upkeep(spark, scratch(spark, "upkeep"), "")
    kept.run(changes, scratch(spark, "upkeep-checkpoint"))
    lost = kept.lost().groupBy("source").agg(F.count(F.lit(1)).alias("lost"))
    heads, n = kept.heads(), F.coalesce("lost", F.lit(0).cast("long")).alias("lost")
    return heads.join(lost, "source", "full").select("source", "hash", "seq", n)


@query(f"""WITH {DOCS}, now AS (SELECT path, CASE WHEN doc_id % 5 = 0 THEN content || chr(10) || chr(10) || 'more' ELSE content END AS content FROM docs WHERE doc_id % 7 != 0)
  SELECT path AS source, sha256(path || chr(10) || content) AS hash, CASE WHEN epoch THEN 0 ELSE 1 END AS seq, len(list_filter(regexp_split_to_array(content, '\\n\\n+'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g') != '')) AS chunks
  FROM now JOIN (SELECT path, doc_id % 5 != 0 AS epoch FROM docs) USING (path)""")
def upkeep_reindex(spark, folder):
    """All documents as one batch, then as another what has changed, was deleted and is there
    no more: the state that a full reindex would give."""
    d = A.docs(spark, folder)

    def sources(docs):
        return docs.select(F.col("path").alias("source"), I.content_hash("path", "content").alias("hash"), F.size(C.paragraphs("content")).alias("chunks"))

    kept = Upkeep(spark, scratch(spark, "upkeep"), "chunks int")
    kept.commit(kept.changes(sources(d)), 0)
    later = F.when(F.col("doc_id") % 5 == 0, F.concat("content", F.lit("\n\nmore"))).otherwise(F.col("content"))
    kept.commit(kept.changes(sources(d.filter("doc_id % 7 != 0").withColumn("content", later)), 1), 1)
    return kept.current().select("source", "hash", F.col("seq").cast("int").alias("seq"), "chunks")
