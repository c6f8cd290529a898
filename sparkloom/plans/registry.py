"""Queries by name, with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
MODULES = ["retrieval", "reports", "knowledge", "scalars", "maintenance", "streams", "views", "upkeep"]


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def load() -> None:
    for name in MODULES:
        import_module(f"sparkloom.plans.{name}")


#: The adapters of sparkloom.sources.adapters in DuckDB's SQL.
DOCS = """docs AS (SELECT doc_id, source || '/' || doc_id AS path,
  array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')[1:6], ' ') AS title,
  [lang, source] AS tags, '' AS description, coalesce(text, '') AS content FROM documents)"""
TASKS = """tasks AS (SELECT o_orderkey AS key, 'task-' || o_orderkey AS id, lower(c_mktsegment) || ' order ' || o_orderkey AS title,
  o_orderpriority || ' for ' || c_name AS description,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'todo' ELSE 'in-progress' END AS status,
  CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'high' WHEN o_orderpriority[1] = '3' THEN 'medium' ELSE 'low' END AS priority,
  c_name AS assignee,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST([] AS VARCHAR[]) ELSE [lower(c_mktsegment), CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'urgent' ELSE 'normal' END] END AS labels,
  CASE WHEN o_orderkey % 10 != 0 THEN 'task-' || (o_orderkey - o_orderkey % 10) ELSE '' END AS parent,
  CASE WHEN o_custkey % 4 = 0 THEN 'specs/' || (o_custkey % 20) ELSE '' END AS spec,
  CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 100 AS INTEGER) END AS ord,
  o_orderdate AS created_at, o_orderdate + to_days(CAST(o_orderkey % 40 AS INTEGER)) AS updated_at,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 7 != 0 THEN o_orderdate + INTERVAL 5 DAY END AS completed_at,
  (o_orderstatus = 'F' AND year(o_orderdate) < 1997) AS archived
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
MEMORIES = """memories AS (SELECT conv_id || '-' || turn AS id,
  array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')[1:5], ' ') AS title,
  CASE role WHEN 'user' THEN 'project' ELSE 'global' END AS layer,
  CASE role WHEN 'user' THEN 'preference' WHEN 'assistant' THEN 'decision' ELSE 'convention' END AS category,
  coalesce(text, '') AS content,
  CASE (conv_id + turn) % 7 WHEN 0 THEN 'proposed' WHEN 1 THEN '' ELSE 'active' END AS status, [role] AS tags,
  TIMESTAMP '2024-01-01' + to_days(CAST(conv_id % 120 AS INTEGER)) AS updated_at, conv_id, turn, role FROM conversations)"""
ENTRIES = """entries AS (SELECT 'te-' || l_orderkey || '-' || l_linenumber AS id, 'task-' || l_orderkey AS task_id,
  l_shipdate AS started_at, CAST(floor(l_quantity) AS BIGINT) * 60 AS duration FROM lineitem)"""
AUDIT = """audit AS (SELECT event_id AS seq, ts, event_type AS tool_name,
  CASE event_type WHEN 'view' THEN 'read' WHEN 'error' THEN 'admin' ELSE 'write' END AS action_class,
  CASE WHEN event_type = 'error' THEN 'error' WHEN k % 10 = 0 THEN 'denied' ELSE 'success' END AS result,
  k % 5 = 0 AS dry_run, CAST(floor(value) AS BIGINT) AS duration_ms, user_id, k
  FROM (SELECT *, CAST(props ->> '$.k' AS INTEGER) AS k FROM events))"""
CHUNKS = """chunks AS (SELECT vec_id, ['doc', 'task', 'memory'][CAST(vec_id % 3 + 1 AS INTEGER)] AS type, 'src-' || (vec_id // 15) AS source,
  'part ' || label || '/section ' || (vec_id % 4) AS header_path, embedding FROM embeddings)"""
EDGES = """edges AS (SELECT 'nation/' || n_nationkey AS source, 'region/' || n_regionkey AS target, 'parent' AS relation FROM nation
  UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey, 'parent' FROM customer
  UNION ALL SELECT 'task/' || o_orderkey, 'customer/' || o_custkey, 'spec' FROM orders
  UNION ALL SELECT 'task/' || o_orderkey, 'task/' || (o_orderkey - o_orderkey % 10), 'depends' FROM orders WHERE o_orderkey % 10 != 0)"""
