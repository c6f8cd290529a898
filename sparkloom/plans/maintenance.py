"""Queries on chunks, index upkeep, history, code search and debounced queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking as C
from ..operators import codesearch as Q
from ..operators import history as H
from ..operators import index as I
from ..operators import trigrams
from ..sources import adapters as A
from ..tables import scratch
from .registry import AUDIT, DOCS, MEMORIES, TASKS, query


@query("SELECT doc_id, (strlen(coalesce(text, '')) + 3) // 4 AS tokens FROM documents")
def token_estimate(spark, folder):
    return A.table(spark, folder, "documents").select("doc_id", X.token_estimate("text").alias("tokens"))


@query("SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS tokens, len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) AS terms FROM documents")
def tokenizer_counts(spark, folder):
    d = A.table(spark, folder, "documents").withColumn("t", X.tokens("text"))
    return d.select("doc_id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("terms"))


@query("SELECT lang, sum(len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')))::BIGINT AS tokens, count(*) AS docs FROM documents GROUP BY lang")
def tok_count_by_lang(spark, folder):
    return A.table(spark, folder, "documents").groupBy("lang").agg(F.sum(F.size(X.tokens("text"))).alias("tokens"), F.count(F.lit(1)).alias("docs"))


PARAS = r"list_filter(list_transform(string_split_regex(x, '\n\n+'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p != '')"


@query(f"WITH t AS (SELECT doc_id, replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) AS x FROM documents), p AS (SELECT doc_id, {PARAS} AS p FROM t) SELECT doc_id, unnest(range(0, len(p))) AS place, unnest(p) AS paragraph FROM p")
def paragraph_split(spark, folder):
    """Every line of a document as a paragraph."""
    d = A.table(spark, folder, "documents").withColumn("x", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return d.select("doc_id", F.posexplode(C.paragraphs("x")).alias("place", "paragraph")).withColumn("place", F.col("place").cast("long"))


EST = "((strlen({0}) + 3) // 4)"
NL2 = "chr(10) || chr(10)"


@query(rf"""WITH RECURSIVE raw AS (SELECT page_id, unnest(x) AS b, unnest(range(1, len(x) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?s)(<h[1-6][^>]*>.*?</h[1-6]>|<p>.*?</p>)', 1) AS x FROM pages)),
  plain AS (SELECT page_id, i, coalesce(nullif(regexp_extract(b, '^<h([1-6])', 1), ''), '0')::INTEGER AS level, trim(regexp_replace(regexp_replace(b, '(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g'), ' ') AS t FROM raw),
  bl AS (SELECT * FROM plain WHERE t != '' OR level > 0),
  hd AS (SELECT page_id, i, t, lead(i) OVER (PARTITION BY page_id ORDER BY i) AS next FROM bl WHERE level > 0),
  body AS (SELECT hd.page_id, hd.i, string_agg(bl.t, {NL2} ORDER BY bl.i) AS t FROM hd JOIN bl ON hd.page_id = bl.page_id AND bl.i > hd.i AND (hd.next IS NULL OR bl.i < hd.next) GROUP BY ALL),
  page AS (SELECT page_id, 'page/' || page_id AS path, (SELECT arg_min(t, i) FROM body WHERE body.page_id = p.page_id) AS lead_, (SELECT arg_max(t, i) FROM hd WHERE hd.page_id = p.page_id) AS top,
    coalesce((SELECT list(t ORDER BY i) FROM bl WHERE bl.page_id = p.page_id AND level = 0), []) AS p FROM pages p),
  n AS (SELECT *, '## Notes' || {NL2} || array_to_string(p, {NL2}) AS whole FROM page),
  f AS (SELECT page_id, p, 0 AS i, 1 AS n, '## Notes' AS content, {EST.format("'## Notes'")} AS tokens FROM n WHERE {EST.format("whole")} > 256
    UNION ALL SELECT page_id, p, i + 1, CASE WHEN closed THEN n + 1 ELSE n END, CASE WHEN closed THEN '## Notes (continued)' ELSE content END || {NL2} || p[i + 1], CASE WHEN closed THEN {EST.format("'## Notes (continued)' || " + NL2 + " || p[i + 1]")} ELSE tokens + {EST.format("p[i + 1]")} END
    FROM (SELECT *, i > 0 AND tokens + {EST.format("p[i + 1]")} > 256 AS closed FROM f WHERE i < len(p))),
  parts AS (SELECT page_id, n AS position, arg_max(content, i) AS content, arg_max(tokens, i) AS tokens FROM f GROUP BY page_id, n UNION ALL SELECT page_id, 1, whole, {EST.format("whole")} FROM n WHERE {EST.format("whole")} <= 256),
  c AS (SELECT path, 0 AS position, '# Metadata' AS section, '' AS header_path, 1 AS level, concat_ws({NL2}, 'Page', lead_) AS content, {EST.format(f"concat_ws({NL2}, 'Page', lead_)")} AS tokens FROM n
    UNION ALL SELECT path, position, '## Notes', concat_ws('/', top, 'Notes'), 2, content, tokens FROM parts JOIN n USING (page_id))
  SELECT path, position, section, header_path, level, content, tokens::INTEGER AS tokens, 'doc:' || path || ':chunk:' || position AS id FROM c""")
def document_chunks(spark, folder):
    """Pages as Markdown, by headings, with all paragraphs once more in a deeper section,
    which is split where it is too large."""
    pages = A.page_markdown(spark, folder)
    paras = F.filter(F.split("content", "\n\n"), lambda x: ~x.startswith("# "))
    text = F.concat("content", F.lit("\n\n## Notes\n\n"), F.array_join(paras, "\n\n"))
    return C.document_chunks(pages.select("path", F.lit("Page").alias("title"), F.lit("").alias("description"), text.alias("content")), 256)


@query(rf"""WITH RECURSIVE {MEMORIES}, m AS (SELECT id, title, replace(content, chr(10), chr(10) || chr(10)) AS x FROM memories),
  b AS (SELECT id, {PARAS} AS p FROM m WHERE {EST.format("x")} > 64 AND trim(x) != ''),
  f AS (SELECT id, p, 1 AS i, 1 AS n, p[1] AS content, {EST.format("p[1]")} AS tokens FROM b
    UNION ALL SELECT id, p, i + 1, CASE WHEN closed THEN n + 1 ELSE n END, CASE WHEN closed THEN p[i + 1] ELSE content || chr(10) || chr(10) || p[i + 1] END, CASE WHEN closed THEN 0 ELSE tokens END + {EST.format("p[i + 1]")}
    FROM (SELECT *, tokens + {EST.format("p[i + 1]")} > 64 AS closed FROM f WHERE i < len(p))),
  parts AS (SELECT id, 'title' AS part, title AS content, {EST.format("title")} AS tokens FROM m WHERE trim(title) != ''
    UNION ALL SELECT id, 'body', x, {EST.format("x")} FROM m WHERE trim(x) != '' AND {EST.format("x")} <= 64
    UNION ALL SELECT id, CASE n WHEN 1 THEN 'body' ELSE 'body:' || n END, arg_max(content, i), arg_max(tokens, i) FROM f GROUP BY id, n)
  SELECT 'memory:' || id || ':' || part AS chunk_id, id, part, content, tokens::INTEGER AS tokens FROM parts""")
def memory_chunks(spark, folder):
    m = A.memories(spark, folder).withColumn("body", F.replace("content", F.lit("\n"), F.lit("\n\n")))
    return C.field_chunks(m.select("id", "title", "body"), "memory", ["title", "body"], 64)


@query(f"WITH {DOCS} SELECT path, sha256(path || chr(10) || title || chr(10) || content) AS hash FROM docs")
def content_hashes(spark, folder):
    return A.docs(spark, folder).select("path", I.content_hash("path", "title", "content").alias("hash"))


@query(f"""WITH {DOCS}, now_ AS (SELECT path AS id, sha256(path || chr(10) || content) AS h FROM docs WHERE doc_id % 10 != 3), then_ AS (SELECT path AS id, sha256(path || chr(10) || CASE WHEN doc_id % 10 = 5 THEN 'old' ELSE content END) AS h FROM docs WHERE doc_id % 10 != 4)
  SELECT coalesce(n.id, t.id) AS id, CASE WHEN t.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'deleted' WHEN n.h != t.h THEN 'changed' ELSE 'same' END AS state FROM now_ n FULL JOIN then_ t ON n.id = t.id""")
def content_hash_delta(spark, folder):
    d = A.docs(spark, folder).withColumn("id", F.col("path"))
    old = d.filter("doc_id % 10 != 4").withColumn("content", F.when(F.col("doc_id") % 10 == 5, "old").otherwise(F.col("content")))
    hashed = lambda x: x.select("id", I.content_hash("path", "content").alias("hash"))
    return I.delta(hashed(d.filter("doc_id % 10 != 3")), hashed(old))


@query("SELECT user_id, max(event_id) FILTER (rn = 1) AS event_id, max(event_type) FILTER (rn = 1) AS event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) GROUP BY user_id")
def latest_by_key(spark, folder):
    e = A.table(spark, folder, "events").select("user_id", "event_id", "event_type", "ts")
    return I.latest(e, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("WITH c AS (SELECT vec_id, ['doc', 'task', 'memory'][CAST(vec_id % 3 + 1 AS INTEGER)] AS type, 'src-' || (vec_id // 15) AS source FROM embeddings) SELECT type, count(*) AS chunks, count(DISTINCT source) AS sources, count(*) AS embedded FROM c GROUP BY type")
def index_statistics(spark, folder):
    return I.statistics(A.chunks(spark, folder))


@query("""WITH c AS (SELECT vec_id, 'src-' || (vec_id // 15) AS source FROM embeddings), gone AS (SELECT DISTINCT source FROM c WHERE vec_id % 40 = 0)
  SELECT vec_id, source, 0 AS fresh FROM c WHERE source NOT IN (SELECT source FROM gone) UNION ALL SELECT 100000 + row_number() OVER (ORDER BY source), source, 1 FROM gone""")
def index_replace(spark, folder):
    from pyspark.sql import Window

    c = A.chunks(spark, folder).select("vec_id", "source", F.lit(0).alias("fresh"))
    gone = c.filter("vec_id % 40 = 0").select("source").distinct()
    new = gone.select((F.row_number().over(Window.orderBy("source")) + 100000).cast("long").alias("vec_id"), "source", F.lit(1).alias("fresh"))
    return I.replaced(c, gone, new).select("vec_id", "source", "fresh")


#: Orders of a customer as revisions of one task.
STATES = """states AS (SELECT 'c-' || o_custkey AS entity, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, o_orderdate AS ts, o_orderstatus AS status, o_orderpriority AS priority, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'owner' || (o_orderkey % 5) END AS owner FROM orders)"""
DIFF = STATES + """, l AS (SELECT entity, version, unnest(['status', 'priority', 'owner']) AS field, unnest([coalesce(lag(status) OVER w, ''), coalesce(lag(priority) OVER w, ''), coalesce(lag(owner) OVER w, '')]) AS old, unnest([status, priority, owner]) AS new FROM states WINDOW w AS (PARTITION BY entity ORDER BY version)),
  diff AS (SELECT * FROM l WHERE old != new)"""


def _states(spark, folder):
    from pyspark.sql import Window

    o = A.table(spark, folder, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(F.concat(F.lit("c-"), F.col("o_custkey").cast("string")).alias("entity"), F.row_number().over(w).cast("long").alias("version"), F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("owner"), (F.col("o_orderkey") % 5).cast("string"))).alias("owner"))


@query(f"WITH {DIFF} SELECT entity, version, field, old, new FROM diff")
def field_diff(spark, folder):
    return H.field_diff(_states(spark, folder), ["status", "priority", "owner"])


@query(f"WITH {DIFF}, r AS (SELECT entity, field, new AS value, row_number() OVER (PARTITION BY entity, field ORDER BY version DESC) AS n FROM diff WHERE version <= 4) SELECT entity, field, value FROM r WHERE n = 1 AND value != ''")
def state_at_revision(spark, folder):
    return H.state_at(H.field_diff(_states(spark, folder), ["status", "priority", "owner"]), 4)


@query(f"WITH {STATES}, v AS (SELECT entity, version, unnest(['status', 'priority', 'owner']) AS field, unnest([status, priority, owner]) AS value FROM states) SELECT * FROM v WHERE value != ''")
def revision_replay(spark, folder):
    s = _states(spark, folder)
    return H.replay(H.field_diff(s, ["status", "priority", "owner"]), s)


@query(f"""WITH {STATES}, n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY version DESC) AS n FROM states), o AS (SELECT *, (n > 5 OR date_diff('day', CAST(ts AS DATE), DATE '2000-01-01') > 900) AND n > 1 AS out FROM n),
  l AS (SELECT *, max(CASE WHEN out THEN version END) OVER (PARTITION BY entity) AS last FROM o), k AS (SELECT * FROM l WHERE last IS NULL OR version > last), g AS (SELECT entity, count(*) AS removed FROM l WHERE version <= last GROUP BY entity)
  SELECT k.entity, k.version, k.version = min(k.version) OVER (PARTITION BY k.entity) AND g.removed IS NOT NULL AS checkpoint, CASE WHEN k.version = min(k.version) OVER (PARTITION BY k.entity) THEN coalesce(g.removed, 0) ELSE 0 END AS removed FROM k LEFT JOIN g ON k.entity = g.entity""")
def retention_trim(spark, folder):
    return H.retained(_states(spark, folder), "2000-01-01", 5, 900)


@query(f"WITH {DIFF}, a AS (SELECT entity, version, count(*) AS changes, count(*) FILTER (field = 'status') AS status_changes FROM diff GROUP BY 1, 2), f AS (SELECT s.ts, a.* FROM a JOIN states s ON a.entity = s.entity AND a.version = s.version WHERE status_changes > 0) SELECT entity, version, ts, changes FROM f ORDER BY ts DESC, entity, version LIMIT 100")
def activity_feed(spark, folder):
    s = _states(spark, folder)
    d = H.field_diff(s, ["status", "priority", "owner"]).groupBy("entity", "version").agg(F.count(F.lit(1)).alias("changes"), F.count_if(F.col("field") == "status").alias("st"))
    return d.filter("st > 0").join(s.select("entity", "version", "ts"), ["entity", "version"]).orderBy(F.desc("ts"), "entity", "version").limit(100).select("entity", "version", "ts", "changes")


@query("WITH s AS (SELECT doc_id, coalesce(text, '') AS a, coalesce(text, '') || 'é' || lang AS b FROM documents) SELECT doc_id, (strlen(b) - strlen(a))::BIGINT AS delta FROM s")
def byte_deltas(spark, folder):
    d = A.table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("a"), F.concat(F.coalesce("text", F.lit("")), F.lit("é"), "lang").alias("b"))
    return d.select("doc_id", H.byte_delta("a", "b").alias("delta"))


#: Parts as code symbols.
SYMBOLS = """symbols AS (SELECT p_partkey AS id, replace(p_name, ' ', '_') AS name, CASE WHEN p_size % 2 = 0 THEN 'function' ELSE 'struct' END AS kind, lower(p_type) AS container, p_name || '(' || lower(p_brand) || ')' AS signature,
  'pkg/' || lower(p_type) || '/file' || (p_partkey % 50) || '.go' AS path, lower(p_type) AS package, CASE WHEN p_partkey % 9 = 0 THEN 'checks the session token' ELSE '' END AS comments, CASE WHEN p_partkey % 4 = 0 THEN 'calls ring' ELSE '' END AS relationships FROM part)"""
FIELDS = {"name": 5.0, "container": 3.0, "signature": 2.5, "comments": 2.0, "path": 1.5, "relationships": 1.2, "package": 1.0, "kind": 0.8}


def _code_sql(terms: list[str]) -> str:
    text = "lower(name || ' ' || kind || ' ' || container || ' ' || signature || ' ' || path || ' ' || package || ' ' || comments || ' ' || relationships)"
    stats = ", ".join(f"count(*) FILTER (contains({text}, '{t}')) AS df{i}" for i, t in enumerate(terms))
    toks = ", ".join(f"regexp_extract_all(lower({n}), '[a-z0-9]+') AS k_{n}" for n in FIELDS)
    tf = lambda n, t: f"len(list_filter(k_{n}, lambda x: x = '{t}'))"
    part = lambda i, t, n, w: f"CASE WHEN {tf(n, t)} > 0 THEN {w} * (CASE WHEN df{i} > 0 THEN 1.0 + (n - df{i} + 0.5) / (df{i} + 0.5) ELSE 0 END) * {tf(n, t)} * 2.2 / ({tf(n, t)} + 1.2 * (0.25 + 0.75 * len(k_{n}) / {float(len(terms))})) ELSE 0 END"
    score = " + ".join(part(i, t, n, w) for i, t in enumerate(terms) for n, w in FIELDS.items())
    q = " ".join(terms)
    boost = f"CASE WHEN lower(name) = '{q}' THEN 10.0 WHEN starts_with(lower(name), '{q}') THEN 6.0 WHEN contains(lower(name), '{q}') THEN 4.0 ELSE 0 END + CASE WHEN container = '{q}' THEN 5.0 ELSE 0 END + CASE WHEN {' OR '.join(f"contains(path, '{t}')" for t in terms)} THEN 2.0 ELSE 0 END"
    asked = [w for w in Q.COMMENT_WORDS if w in terms]
    if asked:
        boost += f" + CASE WHEN {' OR '.join(f"contains(comments, '{w}')" for w in asked)} THEN 3.0 ELSE 0 END"
    return f"WITH {SYMBOLS}, s AS (SELECT count(*) AS n, {stats} FROM symbols), k AS (SELECT symbols.*, s.*, {toks} FROM symbols, s), r AS (SELECT id, path, name, round({score} + {boost}, 6) AS score FROM k) SELECT id, score FROM r WHERE score > 0 ORDER BY score DESC, path, name, id LIMIT 20"


def _symbols(spark, folder):
    p = A.table(spark, folder, "part")
    kind = F.lower("p_type")
    return p.select(F.col("p_partkey").alias("id"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), F.when(F.col("p_size") % 2 == 0, "function").otherwise("struct").alias("kind"), kind.alias("container"), F.concat("p_name", F.lit("("), F.lower("p_brand"), F.lit(")")).alias("signature"), F.concat(F.lit("pkg/"), kind, F.lit("/file"), (F.col("p_partkey") % 50).cast("string"), F.lit(".go")).alias("path"), kind.alias("package"), F.when(F.col("p_partkey") % 9 == 0, "checks the session token").otherwise("").alias("comments"), F.when(F.col("p_partkey") % 4 == 0, "calls ring").otherwise("").alias("relationships"))


@query(_code_sql(["ring", "token"]))
def code_search(spark, folder):
    return Q.code_search(_symbols(spark, folder), "ring token", 20).select("id", "score")


@query(_code_sql(["steel", "e", "token"]))
def code_search_indexed(spark, folder):
    """Symbols by a stored index of parts of words."""
    return trigrams.Index(spark, scratch(spark, "symbols")).build(_symbols(spark, folder)).search("steel e token", 20).select("id", "score")


@query(f"""WITH {DOCS} SELECT path, '# ' || title || chr(10) || 'intro' || chr(10) || '## Notes' || chr(10) || 'new of all' || chr(10) || chr(10) || '## Later' || chr(10) || 'end' AS body, true AS replaced FROM docs""")
def section_replace(spark, folder):
    """A section with a deeper one and a blank line at its end, in every document."""
    d = A.docs(spark, folder).select("path", F.concat_ws("\n", F.concat(F.lit("# "), "title"), F.lit("intro"), F.lit("## My notes"), F.col("path"), F.lit("### Deeper"), F.lit("x"), F.lit(""), F.lit("## Later"), F.lit("end")).alias("body"))
    return C.replace_section(d, "body", "## notes", "## Notes\nnew of all")


@query("""WITH RECURSIVE e AS (SELECT event_id AS seq, ts AS t0, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'rename' END AS op, 'p' || (user_id % 90) AS path, 'p' || (event_id * 7 % 90) AS new_path FROM events),
  k AS (SELECT * FROM e WHERE op != 'rename' OR path != new_path),
  h AS (SELECT seq, t0, op = 'rename' AS moves, path, false AS begins FROM k WHERE op != 'create' UNION ALL SELECT seq, t0, op = 'rename', CASE WHEN op = 'rename' THEN new_path ELSE path END, true FROM k WHERE op != 'delete'),
  w AS (SELECT *, lag(seq) OVER o AS prev, lead(t0) OVER o AS ends, lead(seq) OVER o AS nxt, lead(moves) OVER o AND NOT lead(begins) OVER o AS away FROM h WINDOW o AS (PARTITION BY path ORDER BY t0, seq)),
  i AS (SELECT path, t0 AS starts, ends, path || '#' || seq AS node, CASE WHEN moves THEN seq END AS born, CASE WHEN away THEN nxt END AS gone FROM w WHERE begins
    UNION ALL SELECT path, NULL, t0, path || '#', NULL, CASE WHEN moves THEN seq END FROM w WHERE prev IS NULL AND NOT begins),
  c AS (SELECT a.node, b.node AS parent FROM i a LEFT JOIN i b ON a.born = b.gone),
  walk AS (SELECT node, node AS history FROM c WHERE parent IS NULL UNION ALL SELECT c.node, walk.history FROM walk JOIN c ON c.parent = walk.node)
  SELECT path, starts, ends, history FROM i JOIN walk USING (node)""")
def path_histories(spark, folder):
    """Paths that are created, renamed and deleted, used again and swapped: who held them when."""
    e = A.table(spark, folder, "events")
    op = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").otherwise("rename")
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    return H.path_intervals(e.select(F.col("event_id").alias("seq"), F.col("ts").alias("at"), op.alias("op"), name(F.col("user_id") % 90).alias("path"), name(F.col("event_id") * 7 % 90).alias("new_path")))
