"""The queries of this subpackage: each operator, with production parameters, on its
whole table; and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .encoding import tokenizer_path

BYTE_VOCABULARY = "byte_bpe_50k.json"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_common_lines

    out = drop_common_lines(_documents(spark, sf_dir), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    docs = _documents(spark, sf_dir).select("doc_id", "text")
    out = count_tokens(docs, tokenizer_path("word_bpe_49k.json"), C.scratch(spark, "token-counts"), texts=False)
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    out = remove_repeats(_documents(spark, sf_dir), length=400, keep="none")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    return shard_by_bytes(_documents(spark, sf_dir), shards=8)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import benchmark_hits

    out = benchmark_hits(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    out = out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_documents(spark, sf_dir), shingle=3, bits=3).select("doc_id", "fingerprint", "component_id")


def op7_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .gru_lm import score_documents

    return score_documents(_documents(spark, sf_dir), modulus=7, held=2)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    out = judge(_documents(spark, sf_dir), texts=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import read_documents, write_store

    path = C.scratch(spark, "token-store")
    write_store(_documents(spark, sf_dir), path, tokenizer_path(BYTE_VOCABULARY), end=2)
    return read_documents(spark, path)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_documents(spark, sf_dir), tokenizer_path(BYTE_VOCABULARY), capacity=2048, end=0)


def op11_tandem_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tandem import periodic_runs

    return periodic_runs(_documents(spark, sf_dir), times=4, least=6, planted=True).drop("runs")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import lowered_fifth, manifest

    return manifest(_documents(spark, sf_dir), lowered_fifth())


def op13_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .histogram_packing import pack

    return pack(_documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), capacity=4096, end=2)


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
keyed AS (
  SELECT doc_id, i, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (k IN (SELECT k FROM common)))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (k NOT IN (SELECT k FROM common)), '')) AS kept_sha256
FROM keyed GROUP BY doc_id
"""

OP5_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS g FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, w[g:g + 9] AS x, len(w[g:g + 9]) AS n FROM starts),
lens AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS g FROM docs, lens WHERE len(w) >= n),
hits AS (SELECT p.doc_id, p.g, p.n, x.item_id FROM (SELECT doc_id, g, n, w[g:g + n - 1] AS y FROM places) p JOIN windows x ON p.y = x.x),
covered AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(g, g + n)) AS i FROM (SELECT DISTINCT doc_id, g, n FROM hits)) GROUP BY doc_id),
found AS (SELECT doc_id, count(id) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(f.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN found f ON d.doc_id = f.doc_id
"""

def _field(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


#: The CRC goes bit by bit.  A step of a path holds a run's nodes and the place among them.
CRC_SQL = """xor(list_reduce([4294967295] || list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT),
           lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""
OP12_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, text, {' || '.join(map(_field, ('doc_id::VARCHAR', 'source', 'lang', 'n_chars::VARCHAR')))} AS head,
         CASE WHEN {CRC_SQL} % 5 = 0
              THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS seen FROM documents),
hashed AS (SELECT doc_id, source, sha256(head || {_field('text')}) AS leaf, sha256(head || {_field('seen')}) AS fold FROM docs),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed),
lower_levels AS (
  SELECT 0 AS level, source, pos, leaf AS node, count(*) OVER (PARTITION BY source) AS n FROM leaves
  UNION ALL
  SELECT any_value(level) + 1, source, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 15) // 16)
  FROM lower_levels WHERE n > 1 GROUP BY source, pos // 16),
subroots AS (SELECT source, node AS subroot, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS up, count(*) OVER () AS n FROM lower_levels WHERE n = 1),
upper_levels AS (
  SELECT 0 AS level, up AS pos, subroot AS node, n FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 15) // 16)
  FROM upper_levels WHERE n > 1 GROUP BY pos // 16),
runs AS (
  SELECT source, level, pos // 16 AS run, list(node ORDER BY pos) AS nodes FROM lower_levels WHERE n > 1 GROUP BY ALL),
upper_runs AS (
  SELECT level, pos // 16 AS run, list(node ORDER BY pos) AS nodes FROM upper_levels WHERE n > 1 GROUP BY ALL),
steps AS (
  SELECT l.source, l.pos, r.level, r.nodes, l.pos // (16 ** r.level)::BIGINT % 16 AS nth
  FROM leaves l JOIN runs r ON l.source IS NOT DISTINCT FROM r.source AND l.pos // (16 ** (r.level + 1))::BIGINT = r.run
  UNION ALL
  SELECT l.source, l.pos, 100 + r.level, r.nodes, s.up // (16 ** r.level)::BIGINT % 16
  FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source JOIN upper_runs r ON s.up // (16 ** (r.level + 1))::BIGINT = r.run),
paths AS (
  SELECT source, pos, list(array_to_string(nodes[:nth], '') || '|' || array_to_string(nodes[nth + 2:], '') ORDER BY level) AS path FROM steps GROUP BY source, pos),
walked AS (
  SELECT l.doc_id, l.leaf, s.subroot, (SELECT node FROM upper_levels WHERE n = 1) AS root,
         sha256(replace(array_to_string(coalesce(p.path, []), ''), '|', '')) AS proof_sha256,
         list_reduce([l.fold] || coalesce(p.path, []), lambda d, x: sha256(split_part(x, '|', 1) || d || split_part(x, '|', 2))) AS folded_root
  FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source
  LEFT JOIN paths p ON l.source IS NOT DISTINCT FROM p.source AND l.pos = p.pos)
SELECT *, folded_root = root AS verified FROM walked
"""


def queries() -> dict:
    own = [op1_line_dedup, op2_token_counts, op3_suffix_dedup, op4_sharding, op5_decontamination, op6_simhash, op7_gru_lm, op8_quality, op9_token_store, op10_packing, op11_tandem_runs, op12_merkle, op13_histogram_packing]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op5_decontamination": OP5_SQL, "op12_merkle": OP12_SQL}
