"""The driver's tables seen as the library's entities: docs, tasks, memories, time
entries, audit events, chunks and edges.  Each takes a session and a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def docs(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    return d.select(
        "doc_id",
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"),
        F.array_join(X.first_tokens("text", 6), " ").alias("title"),
        F.array("lang", "source").alias("tags"),
        F.lit("").alias("description"),
        F.coalesce("text", F.lit("")).alias("content"),
    )


def tasks(spark: SparkSession, folder: str) -> DataFrame:
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    key = F.col("o_orderkey")
    name = lambda k: F.concat(F.lit("task-"), k.cast("string"))
    done = F.col("o_orderstatus") == "F"
    rank = F.substring("o_orderpriority", 1, 1)
    return o.join(c, o.o_custkey == c.c_custkey).select(
        key.alias("key"),
        name(key).alias("id"),
        F.concat(F.lower("c_mktsegment"), F.lit(" order "), key.cast("string")).alias("title"),
        F.concat("o_orderpriority", F.lit(" for "), "c_name").alias("description"),
        F.when(done, "done").when(F.col("o_orderstatus") == "O", "todo").otherwise("in-progress").alias("status"),
        F.when(rank.isin("1", "2"), "high").when(rank == "3", "medium").otherwise("low").alias("priority"),
        F.col("c_name").alias("assignee"),
        F.when(key % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lower("c_mktsegment"), F.when(rank.isin("1", "2"), "urgent").otherwise("normal"))).alias("labels"),
        F.when(key % 10 != 0, name(key - key % 10)).otherwise("").alias("parent"),
        F.when(F.col("o_custkey") % 4 == 0, F.concat(F.lit("specs/"), (F.col("o_custkey") % 20).cast("string"))).otherwise("").alias("spec"),
        F.when(key % 4 == 0, (key % 100).cast("int")).alias("order"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderdate") + F.expr("make_interval(0,0,0,int(o_orderkey % 40))")).alias("updated_at"),
        F.when(done & (key % 7 != 0), F.col("o_orderdate") + F.expr("INTERVAL 5 DAYS")).alias("completed_at"),
        (done & (F.year("o_orderdate") < 1997)).alias("archived"),
    )


def memories(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "conversations")
    pick = (F.col("conv_id") + F.col("turn")) % 7
    return m.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.array_join(X.first_tokens("text", 5), " ").alias("title"),
        F.when(F.col("role") == "user", "project").otherwise("global").alias("layer"),
        F.when(F.col("role") == "user", "preference").when(F.col("role") == "assistant", "decision").otherwise("convention").alias("category"),
        F.coalesce("text", F.lit("")).alias("content"),
        F.when(pick == 0, "proposed").when(pick == 1, "").otherwise("active").alias("status"),
        F.array("role").alias("tags"),
        (F.lit("2024-01-01").cast("timestamp") + F.expr("make_interval(0,0,0,int(conv_id % 120))")).alias("updated_at"),
        "conv_id", "turn", "role",
    )


def time_entries(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "lineitem")
    order = F.col("l_orderkey").cast("string")
    return t.select(
        F.concat_ws("-", F.lit("te"), order, F.col("l_linenumber").cast("string")).alias("id"),
        F.concat(F.lit("task-"), order).alias("task_id"),
        F.col("l_shipdate").alias("started_at"),
        (F.col("l_quantity").cast("int") * 60).cast("long").alias("duration"),
    )


def audit(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("seq"),
        "ts",
        kind.alias("tool_name"),
        F.when(kind == "view", "read").when(kind == "error", "admin").otherwise("write").alias("action_class"),
        F.when(kind == "error", "error").when(F.col("k") % 10 == 0, "denied").otherwise("success").alias("result"),
        (F.col("k") % 5 == 0).alias("dry_run"),
        F.floor("value").cast("long").alias("duration_ms"),
        "user_id",
        "k",
    )


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as chunks of sources; five to a source."""
    v = table(spark, folder, "embeddings")
    kind = F.element_at(F.array(F.lit("doc"), F.lit("task"), F.lit("memory")), (F.col("vec_id") % 3 + 1).cast("int"))
    return v.select("vec_id", kind.alias("type"), F.concat(F.lit("src-"), F.expr("vec_id div 15").cast("string")).alias("source"), F.concat(F.lit("part "), F.col("label").cast("string"), F.lit("/section "), (F.col("vec_id") % 4).cast("string")).alias("header_path"), "embedding")


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """Typed edges: nation in region, customer in nation, task of customer, task under task."""
    n, c, o = (table(spark, folder, t) for t in ("nation", "customer", "orders"))
    edge = lambda df, s, t, relation: df.select(s.alias("source"), t.alias("target"), F.lit(relation).alias("relation"))
    name = lambda prefix, k: F.concat(F.lit(prefix), k.cast("string"))
    key = F.col("o_orderkey")
    return (
        edge(n, name("nation/", F.col("n_nationkey")), name("region/", F.col("n_regionkey")), "parent")
        .unionByName(edge(c, name("customer/", F.col("c_custkey")), name("nation/", F.col("c_nationkey")), "parent"))
        .unionByName(edge(o, name("task/", key), name("customer/", F.col("o_custkey")), "spec"))
        .unionByName(edge(o.filter(key % 10 != 0), name("task/", key), name("task/", key - key % 10), "depends"))
    )


def page_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as Markdown: headings and paragraphs of the HTML, one block each."""
    p = table(spark, folder, "pages")
    blocks = F.regexp_extract_all("html", F.lit(r"(?s)(<h[1-6][^>]*>.*?</h[1-6]>|<p>.*?</p>)"), 1)

    def block(b):
        level = F.regexp_extract(b, r"^<h([1-6])", 1)
        plain = F.trim(F.regexp_replace(F.regexp_replace(b, r"(?s)<[^>]*>", ""), r"\s+", " "))
        return F.when(level != "", F.concat(F.repeat(F.lit("#"), F.nullif(level, F.lit("")).cast("int")), F.lit(" "), plain)).otherwise(plain)

    return p.select("page_id", F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("path"), F.array_join(F.filter(F.transform(blocks, block), lambda b: b != ""), "\n\n").alias("content"))
