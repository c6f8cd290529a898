"""State machines on streams against a replay and plain Python."""

import datetime as dt
import random

import pytest

from sparkloom import tables as T
from sparkloom.streaming import queues as Q
from sparkloom.streaming import stateful as S

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def jobs(seed=1, n=300):
    rng = random.Random(seed)
    return [(f"k{rng.randrange(6)}", at(rng.randrange(0, 6000)), f"id{i}", rng.choice([0, 1000, 5000, 90_000])) for i in range(n)]


def outbox(seed=2, n=120):
    rng, rows = random.Random(seed), []
    for i in range(n):
        t = rng.randrange(0, 3000)
        rows.append((f"e{i}", at(t), "pending"))
        for phase in ("deliver", "index"):
            t += rng.randrange(1, 500)
            rows.append((f"e{i}", at(t), f"{phase} {rng.choice(['done', 'done', 'failed'])}"))
        rows.append((f"e{i}", at(t + 700), "deliver done"))
        rows.append((f"e{i}", at(t + 1300), "index done"))
    return rows


MACHINES = {
    "coalescing": (S.Coalescing(), jobs(), "key string, at timestamp, id string, delay_ms long"),
    "leases": (S.Leases(60_000), [r[:2] for r in jobs(3)], "key string, at timestamp"),
    "outbox": (S.Outbox(), outbox(), "key string, at timestamp, op string"),
}
LAST = 20_000


def run_stream(spark, tmp_path, rows, schema, machine, cuts, name):
    """The stream over files of rows in order of time, stopped and started again after each."""
    src, sink, check = (str(tmp_path / f"{name}-{x}") for x in ("src", "sink", "check"))
    rows = sorted(rows, key=lambda r: r[1])
    end = [("end", at(LAST + 600), *([None] * (len(rows[0]) - 2)))]
    edges = [0, *cuts, len(rows)]
    for a, b in zip(edges, edges[1:]):
        part = rows[a:b][:]
        random.Random(a).shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        Q.to_end(S.streamed(stream, machine), sink, check)
    if schema.endswith("delay_ms long"):
        end = [("end", at(LAST + 600), "end", 0)]
    spark.createDataFrame(end, schema).coalesce(1).write.mode("append").parquet(src)
    Q.to_end(S.streamed(spark.readStream.schema(schema).parquet(src), machine), sink, check)
    return sorted((repr(tuple(r)) for r in spark.read.parquet(sink).collect() if r["key"] != "end"))


@pytest.mark.parametrize("name", MACHINES)
def test_stream_with_restarts_equals_the_replay(spark, tmp_path, name):
    machine, rows, schema = MACHINES[name]
    table = spark.createDataFrame(rows, schema).repartition(3)
    want = sorted(repr(tuple(r)) for r in S.replayed(table, machine, at(LAST)).collect())
    assert len(want) > 20
    for cuts in ([], [len(rows) // 3, len(rows) // 2]):
        assert run_stream(spark, tmp_path, rows, schema, machine, cuts, f"{name}{len(cuts)}") == want


def test_coalescing_by_hand(spark):
    rows = [("a", at(0), "first", 5000), ("a", at(4), "second", 5000), ("a", at(9), "third", 5000), ("b", at(1), "x", 0), ("b", at(1), "y", 0), ("a", at(50), "open", 60_000)]
    got = S.replayed(spark.createDataFrame(rows, MACHINES["coalescing"][2]), S.Coalescing(), at(60)).collect()
    assert sorted((r["key"], r["id"], r["run_after"], r["requests"]) for r in got) == [
        ("a", "first", at(9), 2), ("a", "third", at(14), 1), ("b", "x", at(1), 1), ("b", "y", at(1), 1)]


def test_outbox_by_hand(spark):
    box = S.Outbox(lease_ms=300_000, retry_ms=60_000)
    rows = [("good", at(0), "pending"), ("good", at(1), "pending"), ("good", at(10), "deliver done"), ("good", at(20), "index done"), ("good", at(30), "index done"),
            ("lost", at(0), "pending"), ("lost", at(310), "deliver done"), ("lost", at(320), "index done"),
            ("bad", at(0), "pending"), ("bad", at(5), "deliver failed"), ("bad", at(6), "index done"), ("bad", at(70), "deliver done"), (None, at(0), "index done")]
    got = S.replayed(spark.createDataFrame(rows, MACHINES["outbox"][2]), box, at(400)).collect()
    say = lambda key: sorted((r["claimed_at"], r["phase"], r["attempt"]) for r in got if r["key"] == key)
    assert say("good") == [(at(0), "deliver", 1), (at(10), "index", 1), (at(20), "complete", 2)]
    assert say("lost") == [(at(0), "deliver", 1), (at(300), "deliver", 2), (at(300), "index", 1), (at(320), "complete", 3)]
    assert say("bad") == [(at(0), "deliver", 1), (at(5), "index", 1), (at(65), "deliver", 2), (at(70), "complete", 3)]
    assert say(None) == []


def test_empty_tables(spark):
    for machine, _, schema in MACHINES.values():
        assert S.replayed(spark.createDataFrame([], schema), machine, at(1)).collect() == []
