"""JSON sources: audit logs, time entries, version histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT = "timestamp timestamp, toolName string, action string, actionClass string, projectRoot string, dryRun boolean, result string, durationMs bigint, errorMessage string, entityRefs array<string>, argumentSummary map<string,string>, _bad string"
ENTRIES = "map<string,array<struct<id:string,startedAt:timestamp,endedAt:timestamp,duration:bigint,note:string>>>"
VERSIONS = "taskId string, docPath string, versions array<struct<version:int,timestamp:timestamp,author:string,changes:array<struct<field:string,oldValue:string,newValue:string>>,snapshot:map<string,string>>>"


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of a JSONL log; lines that are not such an event are skipped."""
    d = spark.read.schema(AUDIT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return d.filter("_bad IS NULL AND toolName IS NOT NULL").drop("_bad")


def time_entries(spark: SparkSession, path: str) -> DataFrame:
    """A map of tasks to entries as one row for each entry."""
    d = spark.read.text(path, wholetext=True).select(F.from_json("value", ENTRIES).alias("m"))
    e = d.select(F.explode("m").alias("task_id", "entries")).select("task_id", F.explode("entries").alias("e"))
    return e.select("task_id", F.col("e.id").alias("id"), F.col("e.startedAt").alias("started_at"), F.col("e.endedAt").alias("ended_at"), F.col("e.duration").alias("duration"), F.col("e.note").alias("note"))


def versions(spark: SparkSession, path: str) -> DataFrame:
    """Changes of all histories: entity, version, ts, author, field, old, new."""
    d = spark.read.schema(VERSIONS).option("multiLine", True).json(path)
    v = d.select(F.coalesce("taskId", "docPath").alias("entity"), F.explode("versions").alias("v"))
    c = v.select("entity", F.col("v.version").alias("version"), F.col("v.timestamp").alias("ts"), F.col("v.author").alias("author"), F.explode("v.changes").alias("c"))
    return c.select("entity", "version", "ts", "author", F.col("c.field").alias("field"), F.coalesce("c.oldValue", F.lit("")).alias("old"), F.coalesce("c.newValue", F.lit("")).alias("new"))


def activities(changes: DataFrame, kind: str | None = None, limit: int = 50) -> DataFrame:
    """Revisions that change something of a kind, newest first."""
    fields = {"status": ["status"], "assignee": ["assignee"], "content": ["title", "description", "plan", "notes", "content"]}
    some = changes.filter(F.col("field").isin(fields[kind])) if kind else changes
    return some.groupBy("entity", "version", "ts", "author").agg(F.count(F.lit(1)).alias("changes")).orderBy(F.desc("ts"), "entity", "version").limit(limit)
