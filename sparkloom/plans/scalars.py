"""Queries on scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import adapters as A
from .registry import AUDIT, TASKS, query

NAMES = "names AS (SELECT p_partkey AS id, p_name || ' ' || p_type || '_' || p_brand AS s FROM part)"


def _names(spark, folder):
    return A.table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" "), "p_type", F.lit("_"), "p_brand").alias("s"))


WORDS = r"list_filter(string_split_regex(trim(regexp_replace(s, '[_\-]', ' ', 'g')), '\s+'), lambda w: w != '')"
CAP = "upper(w[1]) || lower(w[2:])"


@query(f"""WITH {NAMES}, w AS (SELECT id, s, {WORDS} AS ws FROM names)
  SELECT id, array_to_string(list_transform(ws, lambda w: lower(w)), '-') AS kebab, array_to_string(list_transform(ws, lambda w: lower(w)), '_') AS snake, array_to_string(list_transform(ws, lambda w: {CAP}), '') AS pascal,
  array_to_string(list_transform(ws, lambda w: {CAP}), ' ') AS start, lower(ws[1]) || array_to_string(list_transform(ws[2:], lambda w: {CAP}), '') AS camel FROM w""")
def case_convert(spark, folder):
    return _names(spark, folder).select("id", X.kebab_case("s").alias("kebab"), X.snake_case("s").alias("snake"), X.pascal_case("s").alias("pascal"), X.start_case("s").alias("start"), X.camel_case("s").alias("camel"))


@query(rf"""WITH {NAMES} SELECT id, regexp_replace(regexp_replace(regexp_replace(lower(s), '[^a-z0-9\- _]', '', 'g'), '[\- _]+', '-', 'g'), '^-|-$', '', 'g') AS slug,
  regexp_replace(regexp_replace(lower(s), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS decision, regexp_replace(regexp_replace(s, '[^a-zA-Z0-9\s-]', '', 'g'), '\s+', '-', 'g') AS title FROM names""")
def slugs(spark, folder):
    return _names(spark, folder).select("id", X.slug("s").alias("slug"), X.decision_slug("s").alias("decision"), X.sanitized_title("s").alias("title"))


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity) AS BIGINT) * 173 AS s FROM lineitem), p AS (SELECT *, s // 3600 AS h, s % 3600 // 60 AS m, s % 60 AS x FROM d)
  SELECT l_orderkey, l_linenumber, s AS seconds, CASE WHEN h > 0 AND (m > 0 OR x > 0) THEN printf('%dh%02dm', h, m) WHEN h > 0 THEN printf('%dh', h) WHEN m > 0 AND x > 0 THEN printf('%dm%02ds', m, x) WHEN m > 0 THEN printf('%dm', m) ELSE printf('%ds', x) END AS shown, h * 3600 + m * 60 + x AS parsed FROM p""")
def durations(spark, folder):
    t = A.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") * 173).cast("long").alias("seconds"))
    h, m, s = F.floor(F.col("seconds") / 3600), F.floor(F.col("seconds") % 3600 / 60), F.col("seconds") % 60
    return t.withColumns({"shown": X.duration_text("seconds"), "parsed": X.duration_seconds(F.format_string("%dh%dm%ds", h, m, s))})


@query("""SELECT doc_id, CASE WHEN length(coalesce(text, '')) <= 60 THEN coalesce(text, '') ELSE substring(coalesce(text, ''), 1, 57) || '...' END AS short FROM documents""")
def truncated(spark, folder):
    return A.table(spark, folder, "documents").select("doc_id", X.truncate(F.coalesce("text", F.lit("")), 60).alias("short"))


@query(r"""SELECT doc_id, len(regexp_extract_all(' ' || replace(lower(regexp_replace(coalesce(text, ''), '([^0-9A-Za-z_])', '\1\1', 'g')), 'ı', '') || ' ', '[^0-9a-z_]the[^0-9a-z_]')) AS n, regexp_matches(lower(coalesce(text, '')), '(^|[^0-9a-z_])of the([^0-9a-z_]|$)') AS phrase FROM documents""")
def word_boundaries(spark, folder):
    return A.table(spark, folder, "documents").select("doc_id", X.boundary_count("text", "the").cast("long").alias("n"), X.has_phrase("text", "of the").alias("phrase"))


@query(f"WITH {AUDIT} SELECT seq, CASE action_class WHEN 'read' THEN 'allow' WHEN 'write' THEN CASE WHEN dry_run THEN 'allow' ELSE 'confirm' END ELSE 'deny' END AS decision FROM audit")
def capability_policy(spark, folder):
    from ..operators.policy import decide

    return A.audit(spark, folder).select("seq", decide({"read": "allow", "write": "confirm"}, "action_class", "dry_run").alias("decision"))


@query(f"WITH {TASKS} SELECT id, sha256(id || chr(10) || title) AS hash, substring(sha256(id || chr(10) || title), 1, 12) AS short FROM tasks")
def fingerprints(spark, folder):
    from ..operators.index import content_hash

    return A.tasks(spark, folder).select("id", content_hash("id", "title").alias("hash")).withColumn("short", F.substring("hash", 1, 12))
