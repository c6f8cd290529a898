"""Operators on small inline tables."""

import random
import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators import chunking as C
from sparkloom.operators import codesearch as Q
from sparkloom.operators import embed as EMBED
from sparkloom.operators import fusion as H
from sparkloom.operators import graph as G
from sparkloom.operators import history as V
from sparkloom.operators import index as I
from sparkloom.operators import lexical as K
from sparkloom.operators import lifecycle as L
from sparkloom.operators import memory as M
from sparkloom.operators import policy as P
from sparkloom.operators import refs as R
from sparkloom.operators import reports as A
from sparkloom.operators import retrieve as PACK
from sparkloom.operators import review as D
from sparkloom.operators import validate as CHECK
from sparkloom.operators import vector as VEC


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


@pytest.mark.parametrize("text,want", [("error-code: E_42 foo7", ["error", "code", "e", "42", "foo7"]), ("", []), (None, []), ("Éa b", ["a", "b"])])
def test_tokens(spark, text, want):
    assert value(spark, X.tokens(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("text,phrase,n", [("a éa a_a A", "a", 3), ("c++ and c++x", "c++", 1), ("end. end", "end", 2), (None, "a", 0)])
def test_boundaries_are_ascii(spark, text, phrase, n):
    assert value(spark, X.boundary_count(F.lit(text).cast("string"), phrase)) == n


@pytest.mark.parametrize("given,camel,snake,start", [("my name", "myName", "my_name", "My Name"), ("MyXMLParser2Go", "myXmlParser2Go", "my_xml_parser2_go", "My Xml Parser2 Go"), ("", "", "", ""), ("a-b_c", "aBC", "a_b_c", "A B C")])
def test_cases(spark, given, camel, snake, start):
    c = F.lit(given)
    assert [value(spark, f(c)) for f in (X.camel_case, X.snake_case, X.start_case)] == [camel, snake, start]
    assert value(spark, X.kebab_case(c)) == snake.replace("_", "-")
    assert value(spark, X.pascal_case(c)) == camel[:1].upper() + camel[1:]


@pytest.mark.parametrize("given,want", [("1h30m45s", 5445), ("2h", 7200), ("90s", 90), ("0s", 0), ("", None), ("1d", None), ("x", None), ("1m1h", None)])
def test_durations(spark, given, want):
    assert value(spark, X.duration_seconds(F.lit(given))) == want


def test_policy_durations_and_texts(spark):
    assert value(spark, X.policy_seconds(F.lit("30d"))) == 30 * 86400
    assert [value(spark, X.duration_text(F.lit(s))) for s in (5, 60, 61, 3600, 3660, 3601)] == ["5s", "1m", "1m01s", "1h", "1h01m", "1h00m"]


def test_truncate_snippet_and_slugs(spark):
    assert value(spark, X.truncate(F.lit("abcdefgh"), 6)) == "abc..." and value(spark, X.truncate(F.lit("abc"), 3)) == "abc"
    text = "x" * 60 + "needle" + "y" * 300
    assert value(spark, X.snippet(F.lit(text), "needle", 100)) == "..." + "x" * 40 + "needle" + "y" * 60 + "..."
    assert value(spark, X.snippet(F.lit("none"), "needle")) == ""
    assert value(spark, X.slug(F.lit(" A  b_c!d-"))) == "a-b-cd"
    assert value(spark, X.decision_slug(F.lit("  Use: X & Y "))) == "use-x-y" and value(spark, X.decision_slug(F.lit("!!"))) == "decision"
    assert value(spark, X.byte_limited(F.lit("aéé"), 4)) == "aé"
    assert value(spark, X.yaml_quoted(F.lit("yes"))) == '"yes"' and value(spark, X.yaml_quoted(F.lit("plain text"))) == "plain text"


def corpus(spark, rows):
    d = spark.createDataFrame(rows, "path string, title string, description string, content string, tags array<string>")
    return K.corpus(d, "doc")


def test_bm25_prefers_short_and_titles(spark):
    long = " ".join(["filler"] * 200)
    rows = [("a", "one", "", "needle", []), ("b", "two", "", "needle " + long, []), ("c", "needle here", "", "x", []), ("d", "none", "", "y", [])]
    got = K.keyword_search(corpus(spark, rows), "needle").collect()
    assert [r.id for r in got] == ["c", "a", "b"] and got[0].boost > got[1].boost


def test_blank_and_unknown_queries_match_nothing(spark):
    c = corpus(spark, [("a", "t", "", "text", ["x"])])
    assert K.keyword_search(c, "  ").collect() == [] and K.keyword_search(c, "zzzz").collect() == [] and K.keyword_search(c, "!?").collect() == []
    assert [r.id for r in K.keyword_search(c, "x").collect()] == ["a"]


def test_cosine_edge_cases(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, [3.0, 4.0])]
    d = spark.createDataFrame(rows, "vec_id long, v array<float>").withColumn("c", VEC.cosine(F.col("v"), F.array(F.lit(1.0), F.lit(0.0))))
    assert [round(r.c, 6) for r in d.orderBy("vec_id").collect()] == [1.0, 0.0, 0.0, 0.6]
    assert len(value(spark, VEC.hashed_embedding(F.lit("a b a"), 8))) == 8


def test_fusion_marks_both(spark):
    lists = [spark.createDataFrame(r, "type string, source string, score double") for r in ([("doc", "a", 0.9), ("doc", "b", 0.7)], [("doc", "a", 3.0), ("memory", "m", 2.0)])]
    got = {r.source: (r.score, r.matched_by) for r in H.reciprocal_rank_fusion(*lists, ["type", "source"]).collect()}
    assert got["a"] == (1.0, "semantic,keyword") and got["b"][1] == "semantic" and got["m"][1] == "keyword" and got["b"][0] == got["m"][0]


def test_regroup_keeps_slots(spark):
    rows = [(1, "task", "t1", "", 9.0, "archived"), (2, "doc", "d", "", 8.0, ""), (3, "task", "t2", "", 7.0, "active"), (4, "task", "t3", "", 6.0, "done")]
    d = spark.createDataFrame(rows, "place int, type string, id string, title string, score double, lifecycle string")
    assert [r.id for r in H.regroup_tasks(d).orderBy("place").collect()] == ["t2", "d", "t3", "t1"]


MARKDOWN = """intro
# Guide
lead
## First
alpha

beta
```
# not a heading
```
### Deep
gamma
## Second
delta"""


def test_headings(spark):
    got = [(s.level, s.path, s.content) for s in value(spark, C.headings(F.lit(MARKDOWN)))]
    assert got == [(0, "", "intro"), (1, "Guide", "lead"), (2, "Guide/First", "alpha\n\nbeta\n```\n# not a heading\n```"), (3, "Guide/First/Deep", "gamma"), (2, "Guide/Second", "delta")]


def test_document_chunks(spark):
    d = spark.createDataFrame([("p", "Title", "About", MARKDOWN), ("q", "Plain", "", "just text"), ("r", "Empty", "", None)], "path string, title string, description string, content string")
    got = {(r.path, r.position): r for r in C.document_chunks(d).collect()}
    assert sorted(k for k in got) == [("p", 0), ("p", 1), ("p", 2), ("p", 3), ("q", 0), ("q", 1), ("r", 0)]
    assert got["p", 0].content == "Title\n\nAbout\n\nlead" and got["p", 2].header_path == "Guide/First/Deep" and got["q", 1].section == "# Content"


def plain_packing(parts, first, again, most):
    size = lambda t: (len(t.encode()) + 3) // 4
    out, text, tokens, some = [], first, size(first), False
    for p in parts:
        if some and tokens + size(p) > most:
            out.append((text, tokens))
            text = again + "\n\n" + p
            tokens = size(text)
        else:
            text, tokens, some = text + "\n\n" + p, tokens + size(p), True
    return out + [(text, tokens)] if some else out


@pytest.mark.parametrize("sizes", [[], [3], [40, 40, 40], [10] * 30, [500, 1, 500], [1, 2, 3, 100, 5]])
def test_packing_matches_a_loop(spark, sizes):
    parts = ["é" * n for n in sizes]
    column = F.array(*map(F.lit, parts)) if parts else F.array().cast("array<string>")
    got = value(spark, C.packed(column, F.lit("## S"), F.lit("## S (continued)"), 30))
    assert [(r.content, r.tokens) for r in got] == plain_packing(parts, "## S", "## S (continued)", 30)


def test_sections_and_field_chunks(spark):
    assert value(spark, C.section_of(F.lit(MARKDOWN), "second")) == "delta" and value(spark, C.section_of(F.lit(MARKDOWN), "zzz")) is None
    assert value(spark, C.outline(F.lit("# A\n## B"))) == "- A\n  - B" and value(spark, C.lines(F.lit("a\nb\nc"), 2, 3)) == "b\nc"
    t = spark.createDataFrame([("1", "short", "a" * 100 + "\n\n" + "b" * 100 + "\n\n" + "c" * 100, "")], "id string, description string, plan string, notes string")
    got = {r.part: r.content for r in C.field_chunks(t, "task", ["description", "plan", "notes"], 40).collect()}
    assert list(got) == ["description", "plan", "plan:2", "plan:3"] and got["plan:3"] == "c" * 100


def test_references(spark):
    text = "@task-42. and @doc/a/b.md#top{implements}, @memory/m-1{odd}\n```\n@task/hidden\n```\n@doc/x:3-9 @decision/d1! x@task/inner"
    d = spark.createDataFrame([("s", text)], "id string, t string")
    got = [(r.type, r.target, r.fragment, r.relation, r.valid, r.legacy) for r in R.references(d, "id", "t").orderBy("place").collect()]
    assert got[:5] == [("task", "42", "", "references", True, True), ("doc", "a/b.md", "#top", "implements", True, False), ("memory", "m-1", "", "odd", False, False), ("doc", "x", ":3-9", "references", True, False), ("decision", "d1", "", "references", True, False)]
    assert R.references(d, "id", "t").filter("canonical = '@task/42'").count() == 1
    assert value(spark, R.rewrite_doc_path(F.lit("@doc/a#x @doc/ab @doc/a/b @doc/a."), "a", "z")) == "@doc/z#x @doc/ab @doc/a/b @doc/z."


def test_walks(spark):
    e = spark.createDataFrame([("a", "b", "depends"), ("b", "c", "depends"), ("c", "d", "depends"), ("x", "a", "spec")], "source string, target string, relation string")
    root = spark.createDataFrame([("a",)], "n string")
    assert {(r.source, r.depth) for r in G.walk(e, root, 2).collect()} == {("a", 1), ("b", 2)}
    assert {r.source for r in G.walk(e, root, 3, "inbound").collect()} == {"x"}
    assert {r.node: r.hops for r in G.distances(e, "a", 2).collect()} == {"a": 0, "b": 1, "x": 1, "c": 2}


def test_cycles_and_descendants(spark):
    p = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "f")], "id string, parent string")
    assert {r.node for r in G.cycles(p).collect()} == {"a", "b", "c", "d"}
    t = spark.createDataFrame([("r", "", "done", False), ("k", "r", "done", False), ("g", "k", "todo", False), ("h", "k", "todo", True)], "id string, parent string, status string, archived boolean")
    assert {r.id: r.descendants for r in L.unfinished_descendants(t).collect()} == {"r": ["g"], "k": ["g"]}


def test_chains_of_any_length(spark):
    ring = [(f"r{i}", f"r{(i + 1) % 40}") for i in range(40)]
    chain = [(f"c{i}", f"c{i + 1}") for i in range(100)]
    tail = [("t2", "t1"), ("t1", "r7")]
    p = spark.createDataFrame(ring + chain + tail + [("self", "self")], "id string, parent string")
    assert {r.node for r in G.cycles(p).collect()} == {x for x, _ in ring + tail} | {"self"}
    up = {(r.node, r.ancestor): r.steps for r in G.ancestors(p.filter("id IN ('c0', 'c99', 't2')"), p).collect()}
    assert {k: v for k, v in up.items() if k[0] == "c0"} == {("c0", f"c{i}"): i for i in range(1, 101)} and up["c99", "c100"] == 1
    assert {a for n, a in up if n == "t2"} == {"t1"} | {x for x, _ in ring} and up["t2", "r6"] == 41
    roots = {r.node: (r.root, r.depth) for r in G.roots(p).collect()}
    assert roots == {f"c{i}": ("c100", 100 - i) for i in range(100)}
    assert G.cycles(p.limit(0)).collect() == [] and G.roots(p.limit(0)).collect() == [] and G.ancestors(p.limit(0), p.limit(0)).collect() == []
    t = spark.createDataFrame([(f"c{i}", f"c{i + 1}" if i < 100 else "", "todo" if i == 0 else "done", False) for i in range(101)], "id string, parent string, status string, archived boolean")
    assert {r.id: r.descendants for r in L.unfinished_descendants(t).collect()} == {f"c{i}": ["c0"] for i in range(1, 101)}


def test_batches_of_the_lifecycle(spark):
    rows = [("a", "", "done", False, at(1)), ("b", "", "todo", False, None), ("c", "", "done", True, at(1)), ("p", "", "done", False, at(1)), ("k", "p", "todo", False, None)]
    t = spark.createDataFrame(rows, "id string, parent string, status string, archived boolean, completed_at timestamp")
    none = spark.createDataFrame([], "task_id string")
    look = {r.id: (r.eligible, r.changed, r.before, r.after, r.reasons) for r in L.archived_batch(t, none, "2024-06-01").collect()}
    assert look["a"] == (True, False, "done", "done", "") and look["b"] == (False, False, "active", "active", "not_done")
    assert look["c"] == (False, False, "archived", "archived", "already_archived") and look["p"][4] == "unfinished_descendant"
    done = {r.id: (r.eligible, r.changed, r.after, r.archived_at is None) for r in L.archived_batch(t, none, "2024-06-01", execute=True).collect()}
    assert done["a"] == (True, True, "archived", False) and done["c"] == (True, True, "archived", False) and done["b"] == (False, False, "active", True)
    ids = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("x",)], "id string")
    back = {r.id: (r.eligible, r.changed, r.after, r.status, r.reasons) for r in L.reopened_batch(t, ids, True, "done").collect()}
    assert back == {"a": (True, True, "active", "todo", ""), "b": (False, False, "active", "todo", "already_active"), "c": (True, True, "active", "todo", ""), "x": (False, False, None, None, "not_found")}
    stones = spark.createDataFrame([("a", "me", "old"), ("gone", "me", "spam")], "id string, actor string, reason string")
    ids = spark.createDataFrame([("a",), ("b",), ("gone",), ("x",)], "id string")
    dead = {r.id: (r.eligible, r.changed, r.before, r.after, r.reasons) for r in L.deleted_batch(t, stones, ids, "me", " spam ", True, True).collect()}
    assert dead == {"a": (False, False, "done", "done", "tombstone_conflict"), "b": (True, True, "active", "archived", ""), "gone": (True, False, "archived", "archived", "already_deleted"), "x": (False, False, None, None, "not_found")}
    assert {r.reasons for r in L.deleted_batch(t, stones, ids, "me", " ", False).collect()} == {"confirmation_required,delete_reason_required"}


def test_section_replace(spark):
    text = "# One\nbody\n\n## Notes here\nold\n### Deep\nx\n\n\n## Later\nend\n##not\n#\nlast"
    d = spark.createDataFrame([(1, text), (2, "no heading"), (3, None)], "i int, t string")
    got = lambda w, b: [(r.t, r.replaced) for r in C.replace_section(d, "t", w, b).orderBy("i").collect()]
    assert got("## notes", "## Notes\nnew") == [("# One\nbody\n\n## Notes\nnew\n\n## Later\nend\n##not\n#\nlast", True), ("no heading", False), (None, False)]
    assert got("4", "## Z\n")[0][0] == text.replace("## Later\nend\n##not\n#\nlast", "## Z\n\n#\nlast")
    assert got("one", "# One")[0][0] == "# One\n#\nlast"


def test_validation_codes(spark):
    t = spark.createDataFrame([("1", "", "odd", "", ["a", "a"], "9", "s", [], [("x", False)]), ("2", "t", "done", "low", [], "", "", ["s1"], [("x", False)]), ("3", "t", "todo", "low", [], "3", "doc", [], [])], "id string, title string, status string, priority string, labels array<string>, parent string, spec string, fulfills array<string>, acceptance array<struct<text:string,completed:boolean>>")
    got = {(r.id, r.code) for r in CHECK.validate_tasks(t, spark.createDataFrame([("doc",)], "path string")).collect()}
    assert got == {("1", c) for c in ("TASK_NO_TITLE", "TASK_INVALID_STATUS", "TASK_NO_PRIORITY", "TASK_DUPLICATE_LABELS", "BROKEN_TASK_REF", "BROKEN_DOC_REF")} | {("2", "TASK_FULFILLS_NO_SPEC"), ("2", "TASK_DONE_UNCHECKED_AC"), ("3", "TASK_CIRCULAR_PARENT")}
    sdd = {(r.id, r.code) for r in CHECK.validate_tasks(t, spark.createDataFrame([("doc",)], "path string"), "sdd").collect()}
    assert sdd - got == {("3", "SDD_NO_AC")} and [CHECK.in_scope("task", s) for s in ("all", "sdd", "docs")] == [True, True, False]
    m = spark.createDataFrame([("1", "t", "c", "odd", "merged", "sure", 5, [], "", "", at(1)), ("2", "t", "c", "project", "rejected", "", 0, ["s"], "", "", at(1))], "id string, title string, content string, layer string, status string, confidence string, ttl_days int, sources array<string>, merged_into string, rejected_reason string, last_verified timestamp")
    got = {(r.id, r.code) for r in CHECK.validate_memories(m, "2024-02-01").collect()}
    assert got == {("1", c) for c in ("MEMORY_INVALID_LAYER", "MEMORY_INVALID_CONFIDENCE", "MEMORY_TTL_EXPIRED", "MEMORY_MISSING_SOURCE", "MEMORY_MISSING_TRUST_METADATA", "MEMORY_MERGED_MISSING_TARGET")} | {("2", "MEMORY_REJECTED_MISSING_REASON"), ("2", "MEMORY_MISSING_TRUST_METADATA")}
    m = spark.createDataFrame([("m1", ["@task/t1", "@task-t9", "@doc/a/b#top", "@doc/z", "@memory/m1", "@memory/m7", "@decision/d1.", "@decision/d2", "@decision/d9", "a talk", ""]), ("m2", [])], "id string, sources array<string>")
    tasks, docs = spark.createDataFrame([("t1",)], "id string"), spark.createDataFrame([("a/b",)], "path string")
    decisions = spark.createDataFrame([("d1", "accepted", []), ("d2", "accepted", ["d1"])], "id string, status string, superseded_by array<string>")
    got = sorted((r.id, r.code) for r in CHECK.validate_memory_sources(m, tasks, docs, decisions).collect())
    assert got == [("m1", "MEMORY_BROKEN_SOURCE_REF")] * 4 + [("m1", "MEMORY_SOURCE_DECISION_SUPERSEDED")]
    d = spark.createDataFrame([("a", "", "", "", False, None), ("b", "", "", "", True, None), ("c", "", "", "", False, "bad")], "path string, title string, description string, content string, imported boolean, parse_error string")
    assert sorted((r.id, r.code) for r in CHECK.validate_docs(d).collect()) == [("a", "DOC_NO_CONTENT"), ("a", "DOC_NO_DESCRIPTION"), ("a", "DOC_NO_TITLE"), ("c", "DOC_PARSE_ERROR")]
    kinds = "id string, name string, doc string, actions array<struct<template:string,path:string>>"
    tp = spark.createDataFrame([("p1", "one", "a", [("ok.hbs", "src/{{name}}.py"), ("bad.hbs", "x/{{name"), ("gone.hbs", "")]), ("p2", "two", "zz", [("", "y")])], kinds)
    files = spark.createDataFrame([("p1", "ok.hbs", "{{#if a}}{{b}}{{/if}}"), ("p1", "bad.hbs", "{{#if a}}{{b}}")], "id string, name string, content string")
    got = sorted((r.id, r.code, r.level) for r in CHECK.validate_templates(tp, files, docs.unionByName(spark.createDataFrame([("a",)], "path string")), fix=True).collect())
    assert got == [("p1", "TEMPLATE_FILE_MISSING", "error"), ("p1", "TEMPLATE_PARSE_ERROR", "error"), ("p1", "TEMPLATE_PATH_ERROR", "error"), ("p2", "BROKEN_DOC_REF", "info")]
    assert {r.code for r in CHECK.validate_templates(spark.createDataFrame([("", [])], "name string, actions array<string>").withColumn("id", F.col("name"))).collect()} == {"TEMPLATE_NO_NAME", "TEMPLATE_NO_ACTIONS"}
    assert {(r.level, r.n) for r in CHECK.summary(CHECK.validate_tasks(t, spark.createDataFrame([("doc",)], "path string")), strict=True).collect()} == {("error", 7), ("info", 2)}


def test_review(spark):
    rows = [("a", "Use Redis cache", "pattern", "we keep sessions in redis", []), ("b", "use  redis CACHE", "pattern", "other words entirely here", []), ("c", "Third", "x", "we keep sessions in redis", []), ("d", "Nothing", "x", "no shared content at all", [])]
    e = spark.createDataFrame(rows, "id string, title string, category string, content string, tags array<string>")
    got = {(r.a, r.b): (r.score, r.reasons) for r in D.review_pairs(e).collect()}
    assert got["a", "b"][0] == 1.0 and "title" in got["a", "b"][1] and got["a", "c"][0] == 1.0 and len(got) == 2
    d = spark.createDataFrame([("1", "Storage engine choice"), ("2", "Choice of storage format"), ("3", "The format")], "id string, title string")
    assert {(r.a, r.b): r.score for r in D.topic_conflicts(d).collect()} == {("1", "2"): 0.82}
    none = "array<string>"
    ds = spark.createDataFrame([("n", "draft", [], []), ("o", "accepted", [], [])], f"id string, status string, supersedes {none}, superseded_by {none}")
    got = {r.id: r.status for r in D.supersede(ds, spark.createDataFrame([("n", "o")], "new_id string, old_id string")).collect()}
    assert got == {"n": "accepted", "o": "superseded"}
    r = spark.createDataFrame([("1", "active", "merge", "x"), ("2", "active", "reject", None), ("3", "stale", "other", None)], "id string, status string, resolution string, match string")
    assert [(x.status, x.merged_into) for x in D.resolve(r).orderBy("id").collect()] == [("merged", "x"), ("rejected", None), ("stale", None)]


def test_archive_reasons(spark):
    rows = [("1", "", "done", False, at(1)), ("2", "", "done", True, None), ("3", "", "todo", False, None), ("4", "", "done", False, None), ("5", "", "done", False, at(30)), ("6", "", "done", False, at(1)), ("7", "6", "todo", False, None)]
    t = spark.createDataFrame(rows, "id string, parent string, status string, archived boolean, completed_at timestamp")
    timers = spark.createDataFrame([("3",)], "task_id string")
    got = {r.id: r.reasons for r in L.archive_eligibility(t, timers, "2024-02-15").collect()}
    assert got == {"1": "", "2": "already_archived", "3": "not_done,active_timer", "4": "completed_at_missing", "5": "retention_pending", "6": "unfinished_descendant", "7": "not_done"}
    w = L.worst_failure(spark.createDataFrame([("o", "a", 1), ("o", "b", 3)], "operation string, kind string, priority int")).first()
    assert w.kind == "b"


def test_prompt_memory(spark):
    for text, skip in (("", True), ("ok", True), ("hi again", True), ("ok redis", False), ("fix it now", False), ("?!?", True)):
        assert value(spark, M.low_signal(F.lit(text))) is skip
    rows = [("p", "Redis cache", "pattern", "details", "project", ["redis"], at(30)), ("g", "Other", "pattern", "redis", "global", [], at(1)), ("n", "None", "x", "y", "project", [], at(30))]
    m = spark.createDataFrame(rows, "id string, title string, category string, content string, layer string, tags array<string>, updated_at timestamp")
    got = {r.id: r.score for r in M.scored(m, "redis cache", [], "cli", "", "2024-02-01").collect()}
    assert got == {"p": pytest.approx(0.12 + 0.7 + 0.12), "g": pytest.approx(0.04 + 0.35 + 0.03)}
    items = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "n int, size int").withColumn("g", F.lit(1))
    assert [(r.n, r.room, r.truncated) for r in M.packed(items.withColumnRenamed("n", "o"), ["g"], [F.col("o")], "size", 35).orderBy("o").collect()] == [(1, 10, False), (2, 20, False), (3, 5, True)]
    p = spark.createDataFrame([("1", "I prefer tabs"), ("2", "hello")], "id string, t string")
    assert [(r.id, r.kind) for r in M.inferred(p, "t", {"preference": (0.92, ["i prefer"]), "context": (0.84, ["note that"])}).collect()] == [("1", "preference")]
    assert M.passes_threshold(spark.createDataFrame([(0.9,), (0.6,)], "score double")).first().inject and not M.passes_threshold(spark.createDataFrame([(0.9,)], "score double")).first().inject


def test_index_upkeep(spark):
    h = lambda rows: spark.createDataFrame(rows, "id string, hash string")
    assert {r.id: r.state for r in I.delta(h([("a", "1"), ("b", "2"), ("c", "3")]), h([("b", "2"), ("c", "9"), ("d", "4")])).collect()} == {"a": "new", "b": "same", "c": "changed", "d": "deleted"}
    up = spark.createDataFrame([("a", None, "n"), ("b", "2", "n"), ("c", "8", "n")], "id string, expected string, hash string")
    assert {r.id: r.hash for r in I.compare_and_set(h([("b", "2"), ("c", "9")]), up).collect()} == {"a": "n", "b": "n", "c": "9"}
    kind = "id string, type string, source string, embedding array<float>"
    c = spark.createDataFrame([("1", "doc", "s", [1.0, 2.0])], kind)
    f = spark.createDataFrame([("1", "doc", "s", [3.0, 4.0]), ("2", "doc", "s", [1.0]), ("3", "code", "t", None), ("4", "doc", "t", [1.0, 1.0]), ("4", "doc", "t", [1.0, 1.0])], kind)
    assert sorted(r.id for r in I.added(c, f, 2).collect()) == ["1", "3", "4"]
    assert I.needs_rebuild({"model": "m", "dimensions": 2, "version": 3}, "m", 2, 4) and not I.needs_rebuild({"model": "m", "dimensions": 2, "version": 4}, "m", 2, 4)


def test_history(spark):
    old, new = "# A\none\n## B\ntwo", "# A\none\n## B\nchanged"
    assert value(spark, V.section_scope(F.lit(old), F.lit(new))) == "A/B"
    assert value(spark, V.section_scope(F.lit(old), F.lit(new.replace("one", "x")))) is None and value(spark, V.section_scope(F.lit(old), F.lit(new.replace("## B", "## C")))) is None
    r = spark.createDataFrame([("e", v, at(v)) for v in range(1, 6)], "entity string, version int, ts timestamp")
    got = V.retained(r, "2024-02-01", most=2).orderBy("version").collect()
    assert [(x.version, x.checkpoint, x.removed) for x in got] == [(4, True, 3), (5, False, 0)]
    assert [x.version for x in V.retained(r, "2025-01-01", days=30).collect()] == [5]
    n = V.identities(spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "old string, new string"))
    assert {x.path: x.history for x in n.collect()} == {"a": "c", "b": "c", "c": "c", "x": "y", "y": "y"}
    a = V.appended(spark.createDataFrame([("e", at(1), "h1"), ("e", at(2), "h1"), ("e", at(3), "h2")], "entity string, ts timestamp, hash string"))
    assert [(x.version, x.checkpoint) for x in a.orderBy("version").collect()] == [(1, True), (2, False)]


def test_code_symbols(spark):
    lines = [("f", 1, "// Login checks", None), ("f", 2, "// the token.", None), ("f", 3, "func Login() {", "Login"), ("f", 4, "x := 1", None), ("f", 5, "func Other() {", "Other")]
    got = {r.symbol: r.comments for r in Q.preceding_comments(spark.createDataFrame(lines, "path string, number int, text string, symbol string")).collect()}
    assert got == {"Login": "Login checks the token.", "Other": ""}
    s = spark.createDataFrame([("1", "Outer", None), ("2", "Inner", "1"), ("3", "leaf", "2")], "id string, name string, parent string")
    assert {r.name: r.container for r in Q.flattened(s).collect()} == {"Outer": "", "Inner": "Outer", "leaf": "Outer.Inner"}


def test_reports_edges(spark):
    timers = spark.createDataFrame([("1", "t", at(1), None, 0), ("2", "t", at(1), at(1, 1), 60_000), ("3", "t", at(20), None, 0)], "id string, task_id string, started_at timestamp, paused_at timestamp, paused_ms long")
    got = [r.x for r in timers.orderBy("id").select(A.elapsed_seconds("started_at", "paused_at", "paused_ms", "2024-01-02").alias("x")).collect()]
    assert got == [86400, 3540, 0]
    tasks = spark.createDataFrame([("1", "done"), ("2", "odd")], "id string, status string")
    assert {(r.status, r.place, r.tasks) for r in A.board(tasks, ["todo", "done"]).collect()} == {("todo", 0, 0), ("done", 1, 1), ("odd", 2, 1)}
    assert value(spark, A.week_start(F.lit("2024-01-10"))) == dt.date(2024, 1, 7)


def test_pack(spark):
    kind = "type string, id string, title string, content string, lifecycle string"
    e = spark.createDataFrame([("doc", "a", "A", "see @task/7 and @doc/b{odd}", ""), ("task", "7", "T", "x", "active"), ("doc", "b", "B", "y", "")], kind)
    found = PACK.candidates(spark.createDataFrame([("doc", "a", 0.8), ("doc", "gone", 0.7)], "type string, id string, score double"), e)
    got = PACK.pack(PACK.merged(found, PACK.expanded(found, e)), 5).collect()
    assert [(r.citation.id, r.score, r.direct, r.expanded_from) for r in got] == [("a", 0.8, True, ""), ("7", 0.4, False, "doc:a")]


def test_policy(spark):
    d = spark.createDataFrame([("read", False), ("write", False), ("write", True), ("odd", True)], "a string, d boolean")
    assert [r.x for r in d.select(P.decide({"read": "allow", "write": "confirm"}, "a", "d").alias("x")).collect()] == ["allow", "confirm", "allow", "deny"]
    m = spark.range(1).select(P.argument_summary(F.create_map(F.lit("body"), F.lit("x" * 500), F.lit("q"), F.lit("y" * 150)), ["body"]).alias("m")).first().m
    assert m["body"] == "<500 chars>" and m["q"] == "y" * 100 + "..."


def flaky(texts):
    """Fails on more than two texts at once and always on a bad one."""
    if len(texts) > 2 or any("bad" in t for t in texts):
        raise OSError("busy")
    return [[float(len(t)), 1.0] for t in texts]


def test_embedding_falls_back_to_single_texts(spark):
    assert EMBED.vectors_of(flaky, ["aaa", "bad", "a", "aa"], 3, 2, 0) == [[3.0, 1.0], None, [1.0, 1.0], [2.0, 1.0]]
    d = spark.createDataFrame([(1, "one two"), (2, None), (3, "one two")], "i int, t string")
    got = {r.i: r.embedding for r in EMBED.embedded(d, "t", EMBED.hashing_provider(384), "multilingual-e5-small", query=True).collect()}
    assert len(got) == 3 and got[1] == got[3] != got[2] and len(got[1]) == 384 and sum(map(abs, got[2])) == 1
    assert EMBED.embedded(d, "t", EMBED.hashing_provider(5), "gte-base").count() == 0


def test_best_matches_of_all_pairs(spark):
    """Copies, one title for many, and near copies, against all pairs."""
    rng = random.Random(4)
    words = [f"word{i}" for i in range(30)]
    rows = []
    for i in range(40):
        base = rng.sample(words, 8)
        rows.append((f"m{i:03d}", " ".join(base[:3]), rng.choice(["a", "b"]), " ".join(base), []))
    rows += [(f"c{i:03d}", *rows[i % 3][1:]) for i in range(25)]
    rows += [(f"t{i:03d}", "one title", rng.choice(["a", "b"]), " ".join(rng.sample(words, 6)), []) for i in range(30)]
    rows += [(f"e{i}", "", "", "", []) for i in range(3)]
    entries = spark.createDataFrame(rows, "id string, title string, category string, content string, tags array<string>")
    sets = D.with_heads(D.prepared(entries))
    ids = spark.createDataFrame([(a[0], b[0]) for a in rows for b in rows if a[0] < b[0]], "a string, b string")
    every = D._scored(ids, sets, D.THRESHOLD)
    both = [(r.a, r.b, r.score) for r in every.collect()]
    want = {}
    for a, b, score in both + [(b, a, s) for a, b, s in both]:
        want.setdefault(a, []).append((-score, b))
    want = {(a, b, -s, n) for a, found in want.items() for n, (s, b) in enumerate(sorted(found)[:5], 1)}
    assert {(r.id, r.match, r.score, r.n) for r in D.best_matches(entries).collect()} == want


def test_memories_of_two_stores_stay_apart(spark):
    kind = "type string, source string, store string, score double, best_chunk long"
    a = spark.createDataFrame([("memory", "m1", "project", 0.5, 1), ("doc", "d", None, 0.4, 2)], kind)
    b = spark.createDataFrame([("memory", "m1", "global", 0.7, 3), ("memory", "m1", "project", 0.6, 4), ("doc", "d", None, 0.3, 5)], kind)
    got = sorted(map(tuple, VEC.merge_stores(a, b).collect()), key=repr)
    assert got == sorted([("memory", "m1", "project", 0.6, 4), ("memory", "m1", "global", 0.7, 3), ("doc", "d", None, 0.4, 2)], key=repr)
    fused = H.reciprocal_rank_fusion(a.fillna("", ["store"]), b.fillna("", ["store"]), ["type", "source", "store"])
    assert {(r.source, r.store) for r in fused.collect()} == {("m1", "project"), ("m1", "global"), ("d", "")}


def test_a_search_says_what_it_lacks(spark):
    from sparkloom.operators import search as SEARCH

    docs = spark.createDataFrame([("d1", "alpha beta", "", "alpha text", ["x"])], "path string, title string, description string, content string, tags array<string>")
    corpus = K.corpus(docs, "doc")
    chunks = spark.createDataFrame([(1, "doc", "d1", "", [1.0, 0.0])], "vec_id long, type string, source string, header_path string, embedding array<float>")
    for args, why in (((None, "alpha", [1.0, 0.0]), "no vector index"), ((chunks, "alpha", None), "no vector"), ((chunks, "alpha", [1.0, 0.0]), "")):
        rows, said = SEARCH.answered(corpus, *args)
        assert why in said and bool(why) == bool(said) and [r.source for r in rows.collect()] == ["d1"]
    rows, said = SEARCH.answered(corpus, chunks, "alpha", [1.0, 0.0], ready=False)
    assert "another model" in said and [r.matched_by for r in rows.collect()] == ["keyword"]
    with pytest.raises(RuntimeError):
        SEARCH.answered(corpus, None, "alpha", None, "semantic")
    assert SEARCH.answered(corpus, None, "alpha", None, "keyword")[1] == ""


def test_review_items_by_hand(spark):
    entries = spark.createDataFrame(
        [("a", "proposed", "2024-03-01", None, ["@doc/x", "@decision/old", "@decision/lost", "plain", "@doc/gone"]), ("b", "active", "2024-01-01", 30, []), ("c", "active", "2024-03-30", 30, ["@task/t"]), ("d", "stale", "2024-03-30", None, None)],
        "id string, status string, updated_at string, ttl_days int, sources array<string>")
    known = spark.createDataFrame([("doc", "x"), ("doc", "x"), ("task", "t")], "type string, id string")
    decisions = spark.createDataFrame([("old", "accepted", ["new", "newer"])], "id string, status string, superseded_by array<string>")
    got = {r.id: r for r in D.review_items(entries, known, decisions, entries.filter("id = 'a'").select("id"), "2024-04-01").collect()}
    assert {k: r.reasons for k, r in got.items()} == {"a": ["proposed", "duplicate_review", "source_decision_superseded", "source_missing"], "b": ["stale_ttl", "missing_source"], "d": ["stale_ttl", "missing_source"]}
    assert [tuple(x) for x in got["a"].repairs] == [("@decision/old", "@decision/new")] and [x.source for x in got["a"].issues] == ["@decision/old", "@decision/lost", "@doc/gone"]
    assert {r.reason: r.n for r in D.reason_counts(D.review_items(entries, known, decisions, entries.select("id").limit(0), "2024-04-01")).collect()}["stale_ttl"] == 2


def test_path_histories_against_a_loop(spark):
    rng = random.Random(8)
    events = [(1, 1, "create", "a", None), (2, 2, "create", "b", None), (3, 3, "rename", "a", "tmp"), (4, 4, "rename", "b", "a"), (5, 5, "rename", "tmp", "b"),  # a swap
              (6, 6, "delete", "a", None), (7, 7, "create", "a", None), (8, 8, "rename", "old", "c"), (9, 9, "rename", "c", "c"), (9, 10, "rename", "free", "d")]
    events += [(10 + i // 2, 11 + i, rng.choice(["create", "rename", "rename", "rename", "delete"]), f"p{rng.randrange(8)}", f"p{rng.randrange(8)}") for i in range(250)]
    rows = spark.createDataFrame(events, "`at` long, seq long, op string, path string, new_path string").repartition(3)
    held, seen, at_time = {}, set(), {}
    for at, seq, op, path, new in events:
        if op == "rename" and path == new:
            continue
        if op != "create" and path not in seen:
            held[path] = f"{path}#"
            at_time.setdefault(0, {})[path] = held[path]
        mine = held.pop(path, None)
        if op == "create":
            held[path] = f"{path}#{seq}"
        elif op == "rename":
            held[new] = mine or f"{new}#{seq}"
        seen |= {path, new} if op == "rename" else {path}
        at_time[at] = dict(held)
    paths = sorted({e[3] for e in events} | {e[4] for e in events if e[4]}) + ["never"]
    # a path that has been there before its first event is there at all earlier times
    early = at_time.pop(0, {})
    first = {p: min(e[0] for e in events if p in (e[3], e[4]) and not (e[2] == "rename" and e[3] == e[4])) for p in paths[:-1]}
    wanted = [(p, t) for p in paths for t in sorted(at_time)]
    want = {(p, t): early.get(p) if t < first.get(p, 0) else at_time[t].get(p) for p, t in wanted}
    got = V.history_at(spark.createDataFrame(wanted, "path string, `at` long"), V.path_intervals(rows)).collect()
    assert {(r["path"], r["at"]): r["history"] for r in got} == want and len(got) == len(wanted)
    assert want[("b", 5)] == "a#1" and want[("a", 5)] == "b#2" and want[("a", 7)] == "a#7" and want[("c", 8)] == "old#"


def test_first_tokens_and_counts_are_those_of_all_tokens(spark):
    """a title does not cut a whole text, and counts are those of its tokens."""
    texts = ["", None, "...", "One", " a-b_c d,E f g h ", "é1 é2é", "order ordering, order;ORDER", "x " * 5000, "-" * 5000, "İ1 Σ2 K"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, f_content string")
    for n in (1, 6):
        got = df.select(X.first_tokens("f_content", n).alias("a"), F.slice(X.tokens("f_content"), 1, n).alias("b")).collect()
        assert [r.a for r in got] == [r.b for r in got]
    assert "split(" in K.counted(df, ["a"])._jdf.queryExecution().optimizedPlan().toString()
    rows = K.counted(df, ["order", "x"]).join(df.select("i", X.tokens("f_content").alias("k"), F.col("f_content").isNull().alias("none")), "i").collect()
    for r in rows:
        assert r.n_content == (None if r.none else len(r.k)) and r.c_content == [r.k.count("order"), r.k.count("x")]
