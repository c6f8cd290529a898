"""Queries on ranked retrieval."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import cells as B
from ..operators import fusion as H
from ..operators import lexical as K
from ..operators import postings as P
from ..operators import vector as V
from ..sources import adapters as A
from ..tables import delete, numbered, scratch, shared_dir
from .registry import CHUNKS, DOCS, MEMORIES, TASKS, query


def _bm25_sql(corpus: str, fields: dict[str, dict[str, float]], text: str, limit: int = 20) -> str:
    ctes, rows = bm25_parts(corpus, fields, text)
    return f"WITH {ctes} {rows} ORDER BY score DESC, list_position(['doc', 'decision', 'task', 'memory'], type), title, id LIMIT {limit}"


def bm25_parts(corpus: str, fields: dict[str, dict[str, float]], text: str) -> tuple[str, str]:
    """Common tables and the query of BM25 over a ``corpus(type, id, title, path, category, tags, f_...)``; the fields'
    weights by type."""
    every = X.query_tokens(text)
    terms = list(dict.fromkeys(every))
    names = list(dict.fromkeys(n for w in fields.values() for n in w))
    toks = ", ".join(f"CASE WHEN f_{n} IS NULL THEN NULL ELSE regexp_extract_all(lower(f_{n}), '[a-z0-9]+') END AS k_{n}" for n in names)
    tf = ", ".join(f"coalesce(len(list_filter(k_{n}, lambda x: x = '{t}')), 0) AS t{i}_{n}" for n in names for i, t in enumerate(terms))
    stats = ", ".join([f"count(*) FILTER ({' OR '.join(f't{i}_{n} > 0' for n in names)}) AS df{i}" for i in range(len(terms))] + [f"avg(len(k_{n})) AS a_{n}" for n in names])
    weight = lambda n: "CASE type " + " ".join(f"WHEN '{k}' THEN {w[n]}" for k, w in fields.items() if n in w) + " ELSE 0 END"
    part = lambda i, n: f"CASE WHEN t{i}_{n} > 0 THEN {weight(n)} * (CASE WHEN df{i} > 0 THEN ln(1 + (docs - df{i} + 0.5) / (df{i} + 0.5)) ELSE 0 END) * t{i}_{n} * 2.2 / (t{i}_{n} + 1.2 * (0.25 + 0.75 * len(k_{n}) / (CASE WHEN a_{n} > 0 THEN a_{n} ELSE 1 END))) ELSE 0 END"
    score = " + ".join(part(i, n) for i in range(len(terms)) for n in names)
    q = text.strip().lower()
    word = lambda t: rf"(^|[^0-9A-Za-z_]){t}([^0-9A-Za-z_]|$)"
    boost = f"CASE WHEN lower(title) = '{q}' THEN 8.0 WHEN regexp_matches(lower(title), '{word(q)}') THEN 4.0 ELSE 0.0 END"
    boost += f" + CASE WHEN path = '' THEN 0.0 WHEN lower(path) = '{q}' THEN 7.0 WHEN contains(lower(path), '{q}') THEN 3.0 ELSE 0.0 END"
    boost += f" + CASE WHEN lower(category) = '{q}' THEN 4.0 WHEN category != '' AND contains(lower(category), '{q}') THEN 2.0 ELSE 0.0 END"
    boost += f" + CASE WHEN len(list_filter(tags, lambda t: lower(t) = '{q}')) > 0 THEN 3.0 ELSE 0.0 END"
    if len(every) > 1:
        boost += " + (" + " + ".join(f"CASE WHEN regexp_matches(lower(title), '{word(t)}') THEN 1 ELSE 0 END" for t in terms) + f") / {float(len(terms))} * 6.0"
    boost += " + CASE WHEN bm25 > 0 THEN CASE type WHEN 'doc' THEN 0.20 WHEN 'task' THEN 0.30 WHEN 'memory' THEN 0.05 WHEN 'decision' THEN 0.18 ELSE 0.0 END ELSE 0.0 END"
    ctes = f"""{corpus}, k AS (SELECT *, {toks} FROM corpus), tf AS (SELECT *, {tf} FROM k),
st AS (SELECT count(*) AS docs, {stats} FROM tf), sc AS (SELECT tf.*, {score} AS bm25 FROM tf, st),
bo AS (SELECT type, id, title, bm25, {boost} AS boost FROM sc)"""
    return ctes, "SELECT type, id, title, round(bm25, 6) AS bm25, round(boost::DOUBLE, 6) AS boost, round(bm25 + boost, 6) AS score FROM bo WHERE round(bm25 + boost, 6) > 0"


DOC_CORPUS = DOCS + """, corpus AS (SELECT 'doc' AS type, path AS id, title, path, '' AS category, tags, title AS f_title, path AS f_path,
  array_to_string(tags, ' ') AS f_tags, description AS f_description, content AS f_content FROM docs)"""
MIXED_CORPUS = f"""{DOCS}, {TASKS}, {MEMORIES}, corpus AS (
  SELECT 'doc' AS type, path AS id, title, path, '' AS category, tags, title AS f_title, path AS f_path, array_to_string(tags, ' ') AS f_tags,
    description AS f_description, content AS f_content, NULL AS f_id, NULL AS f_labels, NULL AS f_status_priority, NULL AS f_category, NULL AS f_layer,
    NULL AS f_plan, NULL AS f_notes, NULL AS f_acceptance FROM docs
  UNION ALL SELECT 'task', id, title, '', '', CAST([] AS VARCHAR[]), title, NULL, NULL, description, NULL, id, array_to_string(labels, ' '), status || ' ' || priority, NULL, NULL,
    '', '', '' FROM tasks WHERE NOT archived
  UNION ALL SELECT 'memory', id, title, '', category, tags, title, NULL, array_to_string(tags, ' '), NULL, content, NULL, NULL, NULL, category, layer,
    NULL, NULL, NULL FROM memories WHERE status IN ('active', ''))"""


def _docs(spark, folder):
    return K.corpus(A.docs(spark, folder), "doc")


def _mixed(spark, folder):
    return K.union_corpus([
        _docs(spark, folder),
        K.corpus(A.tasks(spark, folder).filter("NOT archived"), "task"),
        K.corpus(A.memories(spark, folder).filter("status IN ('active', '')"), "memory"),
    ])


@query(_bm25_sql(DOC_CORPUS, {"doc": K.WEIGHTS["doc"]}, "the token account"))
def bm25_docs(spark, folder):
    """Flagship: keyword search over docs."""
    return K.keyword_search(_docs(spark, folder), "the token account")


@query(_bm25_sql(DOC_CORPUS, {"doc": K.WEIGHTS["doc"]}, "en src3"))
def bm25_docs_by_tag_and_path(spark, folder):
    return K.keyword_search(_docs(spark, folder), "en src3")


@query(_bm25_sql(MIXED_CORPUS, {k: K.WEIGHTS[k] for k in ("doc", "task", "memory")}, "building order urgent", 30))
def bm25_mixed(spark, folder):
    """Docs, live tasks and current memories in one corpus with shared field lengths."""
    return K.keyword_search(_mixed(spark, folder), "building order urgent", 30)


@query(_bm25_sql(MIXED_CORPUS, {k: K.WEIGHTS[k] for k in ("doc", "task", "memory")}, "preference", 25))
def keyword_boosted(spark, folder):
    return K.keyword_search(_mixed(spark, folder), "preference", 25)


def snapshot(spark, paths: list[str]) -> str:
    """A name for the files at some paths as they are: their names, lengths and times."""
    seen = []
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
        seen += [f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in found]
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:32]


def stored_index(spark, folder: str, name: str, corpus, tables: list[str]) -> P.Index:
    """The index of a corpus in the shared folder, built where the tables have none as they are."""
    index = P.Index(spark, f"{shared_dir(spark)}/sparkloom/index-{name}-{snapshot(spark, [f'{folder}/{t}.parquet' for t in tables])}")
    if not index.complete():
        index.update(corpus(spark, folder))
    return index


@query(_bm25_sql(DOC_CORPUS, {"doc": K.WEIGHTS["doc"]}, "the token account"))
def indexed_bm25_docs(spark, folder):
    """The flagship's rows from the stored inverted index."""
    return stored_index(spark, folder, "docs", _docs, ["documents"]).search("the token account")


@query(_bm25_sql(MIXED_CORPUS, {k: K.WEIGHTS[k] for k in ("doc", "task", "memory")}, "building order urgent", 30))
def indexed_bm25_mixed(spark, folder):
    return stored_index(spark, folder, "mixed", _mixed, ["documents", "orders", "customer", "conversations"]).search("building order urgent", 30)


@query(_bm25_sql(DOC_CORPUS, {"doc": K.WEIGHTS["doc"]}, "en src3"))
def indexed_after_updates(spark, folder):
    """An index of older documents after two updates and a compaction is that of the documents."""
    now = _docs(spark, folder)
    turn = F.pmod(F.xxhash64("id"), F.lit(10))
    old = now.filter(turn != 0).withColumn("f_content", F.when(turn == 1, F.lit("en src3 as it was")).otherwise(F.col("f_content")))
    gone = now.filter(turn == 2).withColumns({"id": F.concat("id", F.lit("-gone")), "path": F.concat("path", F.lit("-gone"))})
    index = P.Index(spark, scratch(spark, "index"))
    index.update(old.unionByName(gone))
    index.update(now.filter(turn <= 1), gone.select("type", "id"))
    index.compact()
    return index.search("en src3")


MANY = DOCS + """, q AS (SELECT item_id AS qid, lower(trim(text)) AS q, regexp_extract_all(lower(text), '[a-z0-9]+') AS every FROM benchmark WHERE len(regexp_extract_all(lower(text), '[a-z0-9]+')) > 0),
  words AS (SELECT DISTINCT qid, unnest(every) AS term FROM q),
  k AS (SELECT path, title, tags, unnest(['title', 'path', 'tags', 'description', 'content']) AS f, unnest([4.0, 3.2, 2.2, 1.6, 1.0]) AS w,
    unnest([title, path, array_to_string(tags, ' '), description, content]) AS t FROM docs),
  cut AS (SELECT path, f, w, regexp_extract_all(lower(t), '[a-z0-9]+') AS k FROM k),
  st AS (SELECT f, CASE WHEN avg(len(k)) > 0 THEN avg(len(k)) ELSE 1 END AS a FROM cut GROUP BY f),
  tf AS (SELECT path, f, w, n, term, count(*) AS tf FROM (SELECT path, f, w, len(k) AS n, unnest(k) AS term FROM cut) GROUP BY ALL),
  df AS (SELECT term, ln(1 + ((SELECT count(*) FROM docs) - count(DISTINCT path) + 0.5) / (count(DISTINCT path) + 0.5)) AS idf FROM tf GROUP BY term),
  bm AS (SELECT qid, path, sum(w * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / a))) AS bm25 FROM words JOIN tf USING (term) JOIN df USING (term) JOIN st USING (f) GROUP BY qid, path),
  bo AS (SELECT q.qid, d.path, d.title, coalesce(bm25, 0.0) AS bm25,
    CASE WHEN lower(title) = q THEN 8.0 WHEN contains(' ' || regexp_replace(lower(title), '[^0-9a-z_]', ' ', 'g') || ' ', ' ' || q || ' ') THEN 4.0 ELSE 0.0 END
    + CASE WHEN lower(d.path) = q THEN 7.0 WHEN contains(lower(d.path), q) THEN 3.0 ELSE 0.0 END + CASE WHEN list_contains(list_transform(tags, lambda t: lower(t)), q) THEN 3.0 ELSE 0.0 END
    + CASE WHEN len(every) > 1 THEN len(list_intersect(list_distinct(every), regexp_extract_all(lower(title), '[0-9a-z_]+'))) / len(list_distinct(every))::DOUBLE * 6.0 ELSE 0.0 END
    + CASE WHEN bm25 > 0 THEN 0.2 ELSE 0.0 END AS boost
    FROM q CROSS JOIN docs d LEFT JOIN bm ON bm.qid = q.qid AND bm.path = d.path),
  sc AS (SELECT qid, path AS id, title, round(bm25 + boost, 6) AS score FROM bo WHERE round(bm25 + boost, 6) > 0)
  SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, title, id) AS INTEGER) AS place, id, score FROM sc
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, title, id) <= 3"""


@query("WITH " + MANY)
def benchmark_searches(spark, folder):
    """Every benchmark text as a query, the best three docs of each, in one plan."""
    asked = A.table(spark, folder, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    found = stored_index(spark, folder, "docs", _docs, ["documents"]).search_many(asked, 3)
    return found.select("qid", "place", "id", "score")


WORD_TITLE = r"regexp_matches(lower(title), '(^|[^0-9a-z_]){}([^0-9a-z_]|$)')"
WORD_DESC = r"regexp_matches(lower(description), '(^|[^0-9a-z_]){}([^0-9a-z_]|$)')"


@query(f"""WITH {TASKS}, s AS (SELECT id, round(
  CASE WHEN {WORD_TITLE.format('building order')} THEN CASE WHEN lower(title) = 'building order' THEN 100.0 ELSE 60.0 END WHEN contains(lower(title), 'building order') THEN 30.0 ELSE 0.0 END
  + CASE WHEN contains(id, 'building order') THEN 30.0 ELSE 0.0 END
  + CASE WHEN {WORD_DESC.format('building order')} THEN 25.0 WHEN contains(lower(description), 'building order') THEN 15.0 ELSE 0.0 END
  + 10.0 * len(list_filter(labels, lambda x: contains(lower(x), 'building order')))
  + (CASE WHEN {WORD_TITLE.format('building')} THEN 2.0 WHEN contains(lower(title), 'building') THEN 0.5 ELSE 0.0 END
   + CASE WHEN {WORD_DESC.format('building')} THEN 1.0 WHEN contains(lower(description), 'building') THEN 0.3 ELSE 0.0 END
   + CASE WHEN {WORD_TITLE.format('order')} THEN 2.0 WHEN contains(lower(title), 'order') THEN 0.5 ELSE 0.0 END
   + CASE WHEN {WORD_DESC.format('order')} THEN 1.0 WHEN contains(lower(description), 'order') THEN 0.3 ELSE 0.0 END) / 2.0 * 20.0, 6) AS score FROM tasks)
  SELECT id, score FROM s WHERE score > 0""")
def heuristic_task_scores(spark, folder):
    t = A.tasks(spark, folder).withColumn("score", F.round(K.heuristic_task_score("building order"), 6))
    return t.filter("score > 0").select("id", "score")


@query(f"""WITH {DOCS}, s AS (SELECT path, round(
  CASE WHEN {WORD_TITLE.format('the')} THEN CASE WHEN lower(title) = 'the' THEN 100.0 ELSE 60.0 END WHEN contains(lower(title), 'the') THEN 30.0 ELSE 0.0 END
  + CASE WHEN contains(lower(path), 'the') THEN 25.0 ELSE 0.0 END
  + CASE WHEN regexp_matches(lower(content), '(^|[^0-9a-z_])the([^0-9a-z_]|$)') THEN 20.0 WHEN contains(lower(content), 'the') THEN 10.0 ELSE 0.0 END
  + 10.0 * len(list_filter(tags, lambda x: contains(lower(x), 'the'))), 6)::DOUBLE AS score FROM docs)
  SELECT path, score FROM s WHERE score > 0""")
def heuristic_doc_scores(spark, folder):
    d = A.docs(spark, folder).withColumn("score", F.round(K.heuristic_doc_score("the"), 6))
    return d.filter("score > 0").select("path", "score")


@query(f"""WITH {DOCS}, p AS (SELECT path, content, instr(lower(content), 'token') AS pos FROM docs),
  b AS (SELECT path, content, greatest(0, pos - 41) AS s, least(length(content), pos - 1 + 5 + 110) AS e FROM p WHERE pos > 0)
  SELECT path, CASE WHEN s > 0 THEN '...' ELSE '' END || substring(content, s + 1, e - s) || CASE WHEN e < length(content) THEN '...' ELSE '' END AS snippet FROM b""")
def snippet_extract(spark, folder):
    d = A.docs(spark, folder).withColumn("snippet", X.snippet("content", "token", 150))
    return d.filter("snippet != ''").select("path", "snippet")


COSINE = "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), " + CHUNKS + """, s AS (
  SELECT c.*, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])), 6) AS score FROM chunks c, q)"""


@query(COSINE + " SELECT vec_id, type, source, score FROM s WHERE score >= 0.3 ORDER BY score DESC, vec_id LIMIT 20")
def cosine_topk(spark, folder):
    c = A.chunks(spark, folder)
    return V.top_k(c, V.query_of(c, 0)).select("vec_id", "type", "source", "score")


@query(COSINE + " SELECT vec_id, source, score FROM s WHERE type = 'doc' AND score >= 0.05 ORDER BY score DESC, vec_id LIMIT 15")
def cosine_topk_of_type(spark, folder):
    c = A.chunks(spark, folder)
    return V.top_k(c, V.query_of(c, 0), 15, 0.05, "doc").select("vec_id", "source", "score")


def stored_cells(spark, folder: str) -> B.Cells:
    """The cells of the chunks in the shared folder, built where the table has none as it is."""
    path = f"{shared_dir(spark)}/sparkloom/cells-{snapshot(spark, [f'{folder}/embeddings.parquet'])}"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/cells/_SUCCESS")
    cells = B.Cells(spark, path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        delete(spark, path)
        cells.build(A.chunks(spark, folder))
    return cells


EACH = "WITH " + CHUNKS + """, s AS (SELECT q.vec_id AS qid, c.vec_id, c.type, c.source, round(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score
  FROM chunks c, embeddings q WHERE q.vec_id % 100 = 0)"""


@query(EACH + """ SELECT qid, vec_id, source, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS INTEGER) AS place FROM s WHERE score >= 0.2
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) <= 10""")
def cosine_topk_many(spark, folder):
    """The ten chunks most like each chunk whose id is divisible by 100, from cells."""
    asked = A.chunks(spark, folder).filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
    return stored_cells(spark, folder).top_k(asked, 10, 0.2).select("qid", "place", "vec_id", "source", "score")


ROLLUP = COSINE + """, h AS (SELECT vec_id, type, source, score + CASE WHEN type = 'doc' THEN (CASE WHEN contains(header_path, 'part') THEN 1 ELSE 0 END + CASE WHEN contains(header_path, '2') THEN 1 ELSE 0 END) / 2.0 * 0.15 ELSE 0 END AS score
  FROM s WHERE score >= 0.0),
  n AS (SELECT *, row_number() OVER (PARTITION BY type, source ORDER BY score DESC, vec_id) AS n FROM h),
  rolled AS (SELECT type, source, round(sum(CASE WHEN n = 1 THEN score ELSE score * 0.1 END), 7) AS score, max(CASE WHEN n = 1 THEN vec_id END) AS best_chunk FROM n WHERE n <= 3 GROUP BY type, source)"""


def _rolled(spark, folder):
    c = A.chunks(spark, folder)
    scored = V.top_k(c, V.query_of(c, 0), None, 0.0).withColumn("score", F.col("score") + V.header_boost("part 2"))
    return V.roll_up(scored)


@query(ROLLUP + " SELECT * FROM rolled")
def chunk_rollup(spark, folder):
    return _rolled(spark, folder)


@query("SELECT vec_id, list_transform(embedding, lambda x: round(x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6)) AS unit FROM embeddings")
def vector_normalise(spark, folder):
    v = A.table(spark, folder, "embeddings").withColumn("u", V.normalised(F.col("embedding")))
    return v.select("vec_id", F.transform("u", lambda x: V.rounded(x)).alias("unit"))


FUSED = ROLLUP + """, a AS (SELECT type, source, row_number() OVER (ORDER BY score DESC, type, source) AS s FROM rolled),
  kw AS (SELECT type, source, max(vec_id % 97) * 1.0 AS score FROM chunks GROUP BY type, source),
  b AS (SELECT type, source, row_number() OVER (ORDER BY score DESC, type, source) AS k FROM kw),
  f AS (SELECT coalesce(a.type, b.type) AS type, coalesce(a.source, b.source) AS source, s, k, coalesce(1.0 / (60 + s), 0) + coalesce(1.0 / (60 + k), 0) AS raw FROM a FULL JOIN b ON a.type = b.type AND a.source = b.source),
  fused AS (SELECT type, source, round(raw / (SELECT max(raw) FROM f), 6) AS score, CASE WHEN s IS NOT NULL AND k IS NOT NULL THEN 'semantic,keyword' WHEN s IS NOT NULL THEN 'semantic' ELSE 'keyword' END AS matched_by FROM f)"""


def _fused(spark, folder):
    words = A.chunks(spark, folder).groupBy("type", "source").agg((F.max(F.col("vec_id") % 97) * 1.0).alias("score"))
    return H.reciprocal_rank_fusion(_rolled(spark, folder), words, ["type", "source"])


@query(FUSED + " SELECT * FROM fused")
def rrf_fusion(spark, folder):
    return _fused(spark, folder)


@query(FUSED + """, shares AS (SELECT type, source, score / (SELECT max(score) FROM fused) AS x FROM fused)
  SELECT type, source, floor((CASE WHEN x > 0 AND x < 0.01 THEN 0.01 ELSE x END) * 10000 + 0.5) / 10000 AS score FROM shares""")
def score_normalise(spark, folder):
    return H.normalised_scores(_fused(spark, folder)).select("type", "source", "score")


@query(f"""WITH {TASKS}, b AS (SELECT id, (key % 50) / 50.0 AS score, least(0.3,
   len(regexp_extract_all(lower(title), '(^|[^0-9a-z_])building')) * 0.03 + len(regexp_extract_all(lower(title), '(^|[^0-9a-z_])order')) * 0.03
   + CASE WHEN regexp_matches(lower(title), '(^|[^0-9a-z_])building order([^0-9a-z_]|$)') THEN 0.15 WHEN contains(title, 'building order') THEN 0.05 ELSE 0 END
   + len(list_filter(labels, lambda t: t IN ('building', 'order'))) * 0.05
   + CASE WHEN epoch_us(TIMESTAMP '1998-06-01') - epoch_us(updated_at) < 7 * 86400000000 THEN 0.05 * (1 - (epoch_us(TIMESTAMP '1998-06-01') - epoch_us(updated_at)) / 86400000000.0 / 7) ELSE 0 END) AS bonus
   FROM tasks WHERE updated_at <= TIMESTAMP '1998-06-01')
  SELECT id, round((score + bonus) / (SELECT max(score + bonus) FROM b), 6) AS score FROM b""")
def rerank_tasks(spark, folder):
    t = A.tasks(spark, folder).filter("updated_at <= TIMESTAMP '1998-06-01'").withColumn("score", (F.col("key") % 50) / 50.0)
    return H.rerank(t.withColumn("bonus", H.rerank_bonus("building order", "1998-06-01", "labels", 0.05, None))).select("id", "score")


MIX = f"""WITH {TASKS}, mix AS (SELECT row_number() OVER (ORDER BY score DESC, type, id) AS place, * FROM (
   SELECT 'task' AS type, id, title, ((key % 13) * 1.0)::DOUBLE AS score, CASE WHEN archived THEN 'archived' WHEN status = 'done' THEN 'done' ELSE 'active' END AS lifecycle FROM tasks
   UNION ALL SELECT 'doc', 'doc-' || doc_id, '', ((doc_id % 11) * 1.0)::DOUBLE, '' FROM documents))"""


@query(MIX + """, t AS (SELECT *, row_number() OVER (ORDER BY CASE lifecycle WHEN 'active' THEN 0 WHEN 'done' THEN 1 ELSE 2 END, score DESC, title, id) AS nth FROM mix WHERE type = 'task'),
  p AS (SELECT place, row_number() OVER (ORDER BY place) AS nth FROM mix WHERE type = 'task')
  SELECT place, type, id, title, score, lifecycle FROM mix WHERE type != 'task' UNION ALL SELECT p.place, type, id, title, score, lifecycle FROM t JOIN p ON t.nth = p.nth""")
def historical_regroup(spark, folder):
    life = F.when(F.col("archived"), "archived").when(F.col("status") == "done", "done").otherwise("active")
    tasks = A.tasks(spark, folder).select(F.lit("task").alias("type"), "id", "title", ((F.col("key") % 13) * 1.0).alias("score"), life.alias("lifecycle"))
    docs = A.table(spark, folder, "documents").select(F.lit("doc").alias("type"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), F.lit("").alias("title"), ((F.col("doc_id") % 11) * 1.0).alias("score"), F.lit("").alias("lifecycle"))
    mix = tasks.unionByName(docs)
    mix = numbered(mix, [F.desc("score"), "type", "id"], "place").select("place", *mix.columns)
    return H.regroup_tasks(mix)
