"""Upkeep by epochs against a loop in Python."""

import random

import pytest

from sparkloom.streaming import upkeep as U

SCHEMA = "source string, seq long, expected string, hash string, note string"


def rows(seed, n=400, sources=5):
    rng = random.Random(seed)
    pick = lambda: rng.choice([None, "a", "b", "c"])
    return [(rng.choice([None, *(f"s{i}" for i in range(sources))]), i, pick(), pick(), f"n{i}") for i in range(n)]


def plain(batches, tries=0):
    """(what is held by source, lost) after the batches, one change after the other."""
    held, note, lost = {}, {}, []
    for batch in batches:
        todo = sorted(batch, key=lambda r: r[1])
        for turn in range(tries + 1):
            left = []
            for s, seq, expected, new, n in todo:
                if held.get(s) == expected:
                    held[s], note[s] = new, (seq, n)
                else:
                    left.append((s, seq, expected, new, n))
            if turn < tries:
                todo = [(s, seq, held.get(s), new, n) for s, seq, _, new, n in left]
        lost += [(*r, held.get(r[0])) for r in left]
    return {s: (h, *note[s]) for s, h in held.items() if h is not None}, lost


def state(kept, at=None):
    return {r.source: (r.hash, r.seq, r.note) for r in kept.current(at).collect()}


def order(found):
    return sorted(map(tuple, found), key=str)


def made(spark, tmp_path):
    return U.Upkeep(spark, f"file://{tmp_path}/kept", "note string")


@pytest.mark.parametrize("block", [3, 4096])
def test_batches_equal_a_loop(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(U, "BLOCK", block)
    kept, batches = made(spark, tmp_path), [rows(1), [], [(s, seq + 400, *r) for s, seq, *r in rows(2)]]
    for i, batch in enumerate(batches):
        assert kept.commit(spark.createDataFrame(batch, SCHEMA), i)
    want, lost = plain(batches)
    assert len(want) > 2 and len(lost) > 100
    assert state(kept) == want
    assert order(kept.lost().drop("epoch").collect()) == order(lost)
    first = plain(batches[:1])[0]
    assert state(kept, 0) == state(kept, 1) == first != want


def test_losers_are_tried_again(spark, tmp_path):
    kept, batch = made(spark, tmp_path), rows(3, 60)
    kept.commit(spark.createDataFrame(batch, SCHEMA), 0, tries=2)
    want, lost = plain([batch], 2)
    assert state(kept) == want
    got = kept.lost().drop("epoch", "expected").collect()
    assert order(got) == order((s, seq, new, n, h) for s, seq, _, new, n, h in lost)


def test_a_retry_that_is_given_up_stays_lost(spark, tmp_path):
    kept = made(spark, tmp_path)
    batch = [("a", 1, None, "x", ""), ("a", 2, None, "y", "once more"), ("a", 3, None, "z", "")]
    kept.commit(spark.createDataFrame(batch, SCHEMA), 0, tries=3, redo=lambda d: U.rebased(d.filter("note = 'once more'")))
    assert state(kept) == {"a": ("y", 2, "once more")}
    assert [(r.seq, r.held) for r in kept.lost().collect()] == [(3, "y")]


def test_two_writers_of_one_source(spark, tmp_path):
    kept = made(spark, tmp_path)
    one = lambda seq, expected, new: spark.createDataFrame([("a", seq, expected, new, new or "")], SCHEMA)
    assert kept.commit(one(1, None, "x"), 0, "w")
    assert kept.commit(one(2, "x", "y"), 0, "first")
    assert kept.commit(one(2, "x", "z"), 0, "second")
    assert state(kept) == {"a": ("y", 2, "y")}
    assert [(r.hash, r.held) for r in kept.lost().collect()] == [("z", "y")]
    assert [(r.writer, r.won, r.lost) for r in kept.history().orderBy("epoch").collect()] == [("w", 1, 0), ("first", 1, 0), ("second", 0, 1)]
    assert kept.commit(one(3, "y", None), 1, "first") and state(kept) == {}
    assert kept.commit(one(4, None, "x"), 2, "first") and state(kept) == {"a": ("x", 4, "x")}


def test_a_batch_again_changes_nothing_and_a_failed_one_leaves_no_trace(spark, tmp_path, monkeypatch):
    kept, batch = made(spark, tmp_path), spark.createDataFrame(rows(4, 50), SCHEMA)
    write = kept._write

    def breaks(df, name, epoch):
        if name == "lost":
            raise OSError("lost")
        write(df, name, epoch)

    monkeypatch.setattr(kept, "_write", breaks)
    with pytest.raises(OSError):
        kept.commit(batch, 0)
    assert kept.pinned() == -1 and state(kept) == {}
    monkeypatch.undo()
    assert kept.commit(batch, 0)
    want = plain([rows(4, 50)])[0]
    assert state(kept) == want and not kept.commit(batch, 0)
    assert kept.pinned() == 0 and state(made(spark, tmp_path)) == want


def test_stream_that_is_restarted(spark, tmp_path):
    src, check, every = str(tmp_path / "src"), str(tmp_path / "check"), rows(5, 90)
    for i in range(3):
        spark.createDataFrame(every[30 * i : 30 * i + 30], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        kept = made(spark, tmp_path)
        kept.run(spark.readStream.schema(SCHEMA).parquet(src), check)
        kept.run(spark.readStream.schema(SCHEMA).parquet(src), check)
    assert kept.pinned() == 2 and state(kept) == plain([every])[0]
    # without its checkpoint a stream delivers from the start: batch 0 is known, whatever is in it
    kept.run(spark.readStream.schema(SCHEMA).parquet(src), check + "-lost")
    assert kept.pinned() == 2


def test_changes_equal_a_reindex(spark, tmp_path):
    kept = made(spark, tmp_path)
    tables = [[("a", "1", "x"), ("b", "2", "y"), (None, "3", "z")], [("b", "2", "other"), ("c", "4", "w")], [], [("a", "5", "v")]]
    for i, t in enumerate(tables):
        full = spark.createDataFrame(t, "source string, hash string, note string")
        kept.commit(kept.changes(full, i), i)
        assert {s: v[0] for s, v in state(kept).items()} == {s: h for s, h, _ in t}
        assert kept.changes(full).isEmpty() and kept.lost().isEmpty()
    assert state(kept)["a"] == ("5", 3, "v") and {s: v[0] for s, v in state(kept, 0).items()} == {"a": "1", "b": "2", None: "3"}


def test_odd_rows(spark, tmp_path):
    kept = made(spark, tmp_path)
    batch = [("a", 1, None, "x", "same"), ("a", 1, None, "x", "same"), ("a", None, None, "w", ""), ("b", 1, None, None, None), ("", 1, None, "", "")]
    kept.commit(spark.createDataFrame(batch, SCHEMA), 0)
    # a null place is the first
    assert state(kept) == {"a": ("w", None, ""), "": ("", 1, "")}
    assert [(r.source, r.seq) for r in kept.lost().collect()] == [("a", 1)]
