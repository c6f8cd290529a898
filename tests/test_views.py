"""Combined search and views on small inline tables."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import history as X
from sparkloom.operators import lexical as K
from sparkloom.operators import search as S
from sparkloom.operators import views as W
from sparkloom.sources import sinks
from sparkloom.streaming.progress import Progress


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.fixture(scope="module")
def entities(spark):
    docs = spark.createDataFrame([("d1", "alpha", "", "alpha beta", ["x"]), ("d2", "other", "", "alpha", ["y"])], "path string, title string, description string, content string, tags array<string>")
    tasks = spark.createDataFrame([("t1", "alpha task", "todo", "high", "", [], False), ("t2", "alpha old", "done", "low", "", [], True)], "id string, title string, status string, priority string, description string, labels array<string>, archived boolean")
    memories = spark.createDataFrame([("m1", "alpha", "", "c", "project", "k", ["x"]), ("m2", "alpha", "proposed", "c", "project", "k", ["x"]), ("m3", "alpha", "merged", "c", "project", "k", [])], "id string, title string, status string, content string, layer string, category string, tags array<string>")
    decisions = spark.createDataFrame([("c1", "alpha", "accepted", [], []), ("c2", "alpha", "accepted", ["c1"], []), ("c3", "alpha", "draft", [], [])], "id string, title string, status string, superseded_by array<string>, tags array<string>")
    return docs, tasks, memories, decisions


def ids(df):
    return {r.id for r in df.select("id").collect()}


def test_visibility(entities):
    docs, tasks, memories, decisions = entities
    assert ids(S.corpora(docs, tasks, memories, decisions, "ai")) == {"d1", "d2", "t1", "m1", "c1"}
    assert ids(S.corpora(docs, tasks, memories, decisions, "historical")) == {"d1", "d2", "t1", "t2", "m1", "m2", "m3", "c1", "c2", "c3"}
    assert ids(S.corpora(docs, tasks, memories, decisions, "ai", status="proposed")) == {"d1", "d2", "m2", "c1"}
    assert ids(S.corpora(docs, tasks, memories, decisions, "human", "x", status="todo")) == {"d1", "t1", "m1"}


def test_search_modes(spark, entities):
    corpus = S.corpora(*entities, "ai")
    chunks = spark.createDataFrame([(1, "doc", "d2", "alpha", [1.0, 0.0]), (2, "task", "t1", "", [0.0, 1.0])], "vec_id long, type string, source string, header_path string, embedding array<float>")
    words = S.search(corpus, None, "alpha", None, "hybrid").collect()
    assert {r.source for r in words} == {"d1", "d2", "t1", "m1", "c1"} and {r.matched_by for r in words} == {"keyword"}
    near = S.search(corpus, chunks, "alpha", [1.0, 0.0], "semantic").collect()
    assert [(r.source, round(r.score, 6)) for r in near] == [("d2", 1.15)]
    both = {r.source: r.matched_by for r in S.search(corpus, chunks, "alpha", [1.0, 0.0]).collect()}
    assert both["d2"] == "semantic,keyword" and both["t1"] == "keyword"
    assert {r.type for r in S.search(corpus, chunks, "alpha", [1.0, 0.0], "hybrid", "doc").collect()} == {"doc"}
    assert S.search(corpus, chunks, "  ", [1.0, 0.0]).collect() == []
    assert S.vectors_ready(chunks, {"model": "m", "dimensions": 2, "version": 4}, "m", 2, 4) and not S.vectors_ready(chunks.limit(0), {"model": "m", "dimensions": 2, "version": 4}, "m", 2, 4)
    live = S.live(spark.createDataFrame([("task", "t1"), ("task", "gone"), ("doc", "d1")], "type string, source string"), entities[1])
    assert {(r.source, r.title) for r in live.collect()} == {("t1", "alpha task"), ("d1", None)}
    assert K.TYPE_ORDER[0] == "doc"


def test_criteria_and_specs(spark):
    text = "# S\n- [ ] no\n## Acceptance Criteria\n- [x] a\n- [ ] b\n- [X] c\n## More\n- [x] no"
    d = spark.createDataFrame([(text, "specs/a", []), (None, "b", ["spec"]), ("## Acceptance Criteria\n- [ ] x", "c", [])], "t string, p string, tags array<string>")
    assert [tuple(r.x) for r in d.select(W.criteria_progress("t").alias("x")).collect()] == [(3, 2), (0, 0), (1, 0)]
    assert [r.x for r in d.select(W.is_spec("p", "tags").alias("x")).collect()] == [True, True, False]


def test_tree_and_merged_events(spark):
    t = spark.createDataFrame([("a", ""), ("b", "a"), ("c", "b"), ("d", "")], "id string, parent string")
    assert {r.id: (r.depth, r.root) for r in W.task_tree(t).collect()} == {"a": (0, "a"), "b": (1, "a"), "c": (2, "a"), "d": (0, "d")}
    e = spark.createDataFrame([("g", i, dt.datetime(2024, 1, 1, 0, i), k) for i, k in enumerate("xaabba")], "g string, seq int, ts timestamp, kind string")
    assert [(r.kind, r.events) for r in W.merged_events(e, "g", 5).orderBy("run").collect()] == [("a", 2), ("b", 2), ("a", 1)]


def test_help(spark):
    h = spark.createDataFrame([("doc.get", "read a document"), ("doc.list", "all documents"), ("task.get", "read a task")], "key string, text string")
    get = lambda q: [r.key for r in W.help_matches(h, q).collect()]
    assert get("doc.get") == ["doc.get"] and get("doc.*") == ["doc.get", "doc.list"] and get("READ") == ["doc.get", "task.get"] and get("zzz") == ["doc.get", "doc.list", "task.get"]


def test_restore_and_symbols(spark):
    s = spark.createDataFrame([("e", 1, "todo", ""), ("e", 2, "done", "x"), ("e", 3, "done", "y")], "entity string, version int, status string, owner string")
    changes = X.field_diff(s, ["status", "owner"])
    assert {(r.field, r.old, r.new) for r in W.restored(changes, 1).collect()} == {("status", "done", "todo"), ("owner", "y", "")}
    lines = [("f", 1, "// Foo here"), ("f", 2, '/* Foo'), ("f", 3, "Foo */"), ("f", 4, 'x := "Foo"; y = 1'), ("f", 5, "𝒳 = Foo(1)"), ("f", 6, "Foo")]
    got = W.first_symbol(spark.createDataFrame(lines, "path string, number int, text string"), "Foo").first()
    assert (got.number, got.column) == (5, 5)
    k = spark.createDataFrame([(5,), (26,), (0,), (99,)], "k int")
    assert [r.x for r in k.select(W.symbol_kind("k").alias("x")).collect()] == ["Class", "TypeParameter", "Unknown", "Unknown"]
    assert [r.x for r in spark.createDataFrame([("abc-1",), ("a b",)], "c string").select(W.looks_like_task_id("c").alias("x")).collect()] == [True, False]


def test_texts(spark):
    d = spark.createDataFrame([("d1", "Pick: one", "accepted", [], [], ["t"], [], "why", "what", "", "")], "id string, title string, status string, supersedes array<string>, superseded_by array<string>, tags array<string>, sources array<string>, context string, decision string, alternatives string, consequences string")
    text = d.select(sinks.decision_text().alias("x")).first().x
    assert text == '---\nid: d1\ntitle: "Pick: one"\nstatus: accepted\ntags:\n  - t\n---\n\n## Context\n\nwhy\n\n## Decision\n\nwhat\n'
    m = spark.createDataFrame([("T", "", ["a"], "body")], "title string, description string, tags array<string>, content string")
    assert m.select(sinks.doc_text().alias("x")).first().x == "---\ntitle: T\ntags:\n  - a\n---\n\nbody\n"


def test_progress(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    p = Progress()
    spark.streams.addListener(p)
    try:
        q = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).queryName("copy").trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(50):
            if p.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(p)
    assert sum(b[2] for b in p.batches) == 10 and p.ended
    assert F is not None
