"""Writing: entities as Markdown text, reports as CSV and JSON, chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import yaml_quoted


def _line(name: str, c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), yaml_quoted(c)))


def _list(name: str, c: str) -> Column:
    items = F.array_join(F.transform(c, lambda x: F.concat(F.lit("  - "), yaml_quoted(x))), "\n")
    return F.when(F.size(c) > 0, F.concat(F.lit(f"{name}:\n"), items))


def task_text() -> Column:
    """A task as its file: front matter, then marked sections of what it has."""
    front = F.concat_ws("\n", F.lit("---"), *[_line(n, F.col(n)) for n in ("id", "title", "status", "priority", "assignee")], _list("labels", "labels"), _line("parent", F.col("parent")), _line("spec", F.col("spec")), F.lit("---"))
    return F.concat(front, F.lit("\n\n<!-- SECTION:DESCRIPTION:BEGIN -->\n"), F.coalesce("description", F.lit("")), F.lit("\n<!-- SECTION:DESCRIPTION:END -->\n"))


def _file_text(scalars: list[str], lists: list[str], body: Column) -> Column:
    front = F.concat_ws("\n", F.lit("---"), *[_line(n, F.col(n)) for n in scalars], *[_list(n, n) for n in lists], F.lit("---"))
    return F.concat(front, F.lit("\n\n"), F.coalesce(body, F.lit("")), F.lit("\n"))


def doc_text() -> Column:
    return _file_text(["title", "description"], ["tags"], F.col("content"))


def memory_text() -> Column:
    return _file_text(["id", "title", "layer", "category", "status", "confidence"], ["sources", "tags"], F.col("content"))


def decision_text() -> Column:
    """The four parts under their headings; parts that are blank are left out."""
    part = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"## {c.capitalize()}\n\n"), F.col(c)))
    body = F.concat_ws("\n\n", *[part(c) for c in ("context", "decision", "alternatives", "consequences")])
    return _file_text(["id", "title", "status"], ["supersedes", "superseded_by", "tags", "sources"], body)


def write_csv(report: DataFrame, path: str) -> None:
    """Lists joined by semicolons, with a header."""
    flat = [F.array_join(c, ";").alias(c) if t.startswith("array") else F.col(c) for c, t in report.dtypes]
    report.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON text for each row; what is not set is left out."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "true"}).alias("value"))


def write_chunks(chunks: DataFrame, path: str, types: list[str] | None = None) -> None:
    """A chunk table by type; with ``types`` only those folders are replaced."""
    w = chunks if types is None else chunks.filter(F.col("type").isin(types))
    w.write.mode("overwrite").partitionBy("type").option("partitionOverwriteMode", "dynamic" if types else "static").parquet(path)


def append_audit(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)
