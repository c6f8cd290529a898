"""Sources, sinks and streams on files of their own."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import markdown as MD
from sparkloom.sources import records as REC
from sparkloom.sources import sinks as S
from sparkloom.streaming import queues as QUEUE

DATA = "/root/testdata/sf0.001"


def task(id_, title, more="", updated="2024-01-01T00:00:00Z", body=""):
    return f"---\nid: {id_}\ntitle: {title}\nstatus: todo\npriority: high\nlabels:\n  - a\n  - \"b c\"\nupdatedAt: {updated}\n{more}---\n{body}"


@pytest.fixture
def tree(tmp_path):
    def write(path, text):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)

    body = "<!-- SECTION:DESCRIPTION:BEGIN -->\nWhat it is\n<!-- SECTION:DESCRIPTION:END -->\n<!-- AC:BEGIN -->\n- [x] #1 first\n- [ ] second\n<!-- AC:END -->"
    write("tasks/1.md", task("1", "One", body=body))
    write("tasks/1-old.md", task("1", "Stale", updated="2023-01-01T00:00:00Z"))
    write("tasks/2.md", task("2", "Two", "parent: 1\norder: 3\n"))
    write("tasks/bad.md", "no front matter")
    write("archive/1.md", task("1", "Archived copy"))
    write("archive/3.md", "﻿" + task("3", "Three").replace("\n", "\r\n"))
    write("docs/guide/intro.md", "---\ntitle: 'Intro'\ntags: [x, y]\n---\nText\n")
    write("docs/plain.md", "Only text")
    write("imports/pkg/guide/intro.md", "---\ntitle: Imported\n---\nOther")
    write("imports/pkg/extra.md", "Extra")
    write("mem/memory-1.md", "---\nid: m1\ntitle: Use Tabs\nstatus: active\n---\nalways")
    write("mem2/memory-2.md", "---\nid: m2\ntitle: Other\n---\nx")
    write("decisions/d.md", "---\nid: d1\ntitle: Choice\nstatus: accepted\ntags: [t]\n---\n## Context\nwhy\n## Decision\nwhat\n")
    write("templates/page/template.yaml", "name: page\nactions:\n  - type: add\n  - type: modify\n")
    return tmp_path


def test_tasks(spark, tree):
    got = {r.id: r for r in MD.scan_tasks(spark, str(tree / "tasks"), str(tree / "archive")).collect()}
    assert {i: (r.title, r.archived) for i, r in got.items()} == {"1": ("One", False), "2": ("Two", False), "3": ("Three", True)}
    assert got["1"].description == "What it is" and [(a.text, a.completed) for a in got["1"].acceptance] == [("first", True), ("second", False)]
    assert got["1"].subtasks == ["2"] and got["2"].order == 3 and got["2"].labels == ["a", "b c"]


def test_docs_and_lookup(spark, tree):
    d = MD.scan_docs(spark, str(tree / "docs"), {"pkg": str(tree / "imports/pkg")})
    assert {(r.path, r.title, r.source) for r in d.collect()} == {("guide/intro", "Intro", ""), ("plain", "plain", ""), ("guide/intro", "Imported", "pkg"), ("extra", "extra", "pkg")}
    wanted = spark.createDataFrame([("guide/intro",), ("extra",), ("pkg/guide/intro",), ("none",)], "wanted string")
    assert {r.wanted: (r.path, r.source) for r in MD.find_docs(wanted, d).collect()} == {"guide/intro": ("guide/intro", ""), "extra": ("extra", "pkg"), "pkg/guide/intro": ("guide/intro", "pkg")}


def test_memories_decisions_templates(spark, tree):
    m = MD.scan_memories(spark, {"project": str(tree / "mem"), "global": str(tree / "mem2")})
    assert {r.id: (r.layer, r.missing_fields) for r in m.collect()} == {"m1": ("project", ["confidence", "lastVerified", "sources"]), "m2": ("global", ["status", "confidence", "lastVerified", "sources"])}
    assert {r.wanted: r.id for r in MD.find_memories(spark.createDataFrame([("m2",), ("use-tabs",)], "wanted string"), m).collect()} == {"m2": "m2", "use-tabs": "m1"}
    d = MD.scan_decisions(spark, str(tree / "decisions")).first()
    assert (d.id, d.status, d.tags, d.context, d.decision, d.alternatives) == ("d1", "accepted", ["t"], "why", "what", "")
    t = MD.scan_templates(spark, str(tree / "templates")).first()
    assert (t.name, t.actions) == ("page", ["add", "modify"])
    code = MD.visible_code(spark, str(tree), ["yaml"], ["archive"])
    assert code.count() == 1


def test_records(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text(json.dumps({"timestamp": "2024-01-01T00:00:00Z", "toolName": "doc", "result": "success", "durationMs": 5}) + "\nnot json\n")
    got = REC.audit_log(spark, str(tmp_path / "log.jsonl")).collect()
    assert [(r.toolName, r.durationMs) for r in got] == [("doc", 5)]
    (tmp_path / "time.json").write_text(json.dumps({"t1": [{"id": "a", "startedAt": "2024-01-01T00:00:00Z", "duration": 60}], "t2": []}))
    assert [(r.task_id, r.duration) for r in REC.time_entries(spark, str(tmp_path / "time.json")).collect()] == [("t1", 60)]
    (tmp_path / "v").mkdir()
    (tmp_path / "v/task-1.json").write_text(json.dumps({"taskId": "1", "versions": [{"version": 1, "timestamp": "2024-01-01T00:00:00Z", "changes": [{"field": "status", "newValue": "todo"}]}, {"version": 2, "timestamp": "2024-01-02T00:00:00Z", "changes": [{"field": "title", "oldValue": "a", "newValue": "b"}]}]}))
    c = REC.versions(spark, str(tmp_path / "v"))
    assert [(r.version, r.field, r.old, r.new) for r in c.orderBy("version").collect()] == [(1, "status", "", "todo"), (2, "title", "a", "b")]
    assert [r.version for r in REC.activities(c, "content").collect()] == [2]


def test_sinks(spark, tree, tmp_path):
    t = MD.scan_tasks(spark, str(tree / "tasks"))
    text = t.filter("id = '2'").select(S.task_text().alias("x")).first().x
    (tmp_path / "again").mkdir()
    (tmp_path / "again/2.md").write_text(text)
    back = MD.scan_tasks(spark, str(tmp_path / "again")).first()
    assert (back.id, back.title, back.labels, back.parent) == ("2", "Two", ["a", "b c"], "1")
    S.write_csv(t.select("id", "labels"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).filter("id = '2'").first().labels == "a;b c"
    assert json.loads(S.as_json(t.filter("id = '2'").select("id", "completed_at")).first().value) == {"id": "2"}
    c = spark.createDataFrame([("1", "doc"), ("2", "task")], "id string, type string")
    S.write_chunks(c, str(tmp_path / "chunks"))
    S.write_chunks(spark.createDataFrame([("9", "doc")], "id string, type string"), str(tmp_path / "chunks"), ["doc"])
    assert sorted((r.id, r.type) for r in spark.read.schema("id string, type string").parquet(str(tmp_path / "chunks")).collect()) == [("2", "task"), ("9", "doc")]


def events(spark):
    e = spark.read.parquet(f"{DATA}/events.parquet")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.fixture
def streamed(spark, tmp_path):
    src = str(tmp_path / "src")
    events(spark).repartition(1).sortWithinPartitions("ts").write.option("maxRecordsPerFile", 250).parquet(src)
    schema = events(spark).schema

    def run(f, mode="append"):
        out, check = str(tmp_path / f"{f.__name__}-out"), str(tmp_path / f"{f.__name__}-check")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        QUEUE.to_end(f(stream), out, check, mode)
        return spark.read.parquet(out)

    return run


def debounce(e):
    return QUEUE.debounced(e, "user_id", "ts", "event_type", "2 hours")


def hourly(e):
    return QUEUE.windowed_counts(e, "event_type", "ts")


def first_only(e):
    return QUEUE.once(e.select("event_id", "ts").union(e.select("event_id", "ts")), "event_id", "ts")


@pytest.mark.parametrize("f", [debounce, hourly])
def test_stream_equals_batch_up_to_the_watermark(spark, streamed, f):
    batch = {tuple(r) for r in f(events(spark)).collect()}
    got = [tuple(r) for r in streamed(f).collect()]
    assert len(got) == len(set(got)) and set(got) <= batch and len(got) >= 0.8 * len(batch)


def test_events_are_delivered_once(spark, streamed):
    assert sorted(r.event_id for r in streamed(first_only).collect()) == sorted(r.event_id for r in events(spark).collect())


def test_running_stats_by_batch(spark, tmp_path):
    src = str(tmp_path / "src")
    log = events(spark).select(F.col("event_type").alias("tool_name"), F.when(F.col("event_id") % 2 == 0, "success").otherwise("error").alias("result"))
    log.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(src)
    seen = []
    QUEUE.each_batch(QUEUE.running_stats(stream), lambda df, epoch: seen.append({(r.tool_name, r.result): r.n for r in df.collect()}), str(tmp_path / "check"), "complete")
    assert seen[-1] == {(r.tool_name, r.result): r.n for r in QUEUE.running_stats(log).collect()}


def test_written_tables(spark):
    from sparkloom import tables

    mark = tables.written()
    a, b = (tables.stored(spark.range(n), "test") for n in (3, 5))
    files = a.inputFiles()
    tables.forget(spark, mark, keep=1)
    assert tables.written() == mark + 1 and b.count() == 5
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)
    rows = tables.numbered(spark.createDataFrame([(x % 7, x) for x in range(50)], "a int, b int").repartition(5), [F.desc("a"), "b"], "n").orderBy("n").collect()
    assert [r.n for r in rows] == list(range(1, 51)) and [(r.a, r.b) for r in rows] == sorted(((x % 7, x) for x in range(50)), key=lambda t: (-t[0], t[1]))
