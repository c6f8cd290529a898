"""Pairs of similar sets, best matches, reviews and topics against all pairs in plain Python."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators import review as D

SCHEMA = "id string, title string, category string, content string, tags array<string>"


@pytest.fixture(params=[4096, 5])
def few(request, monkeypatch):
    """With the rows of a frequent token in one block and in many."""
    monkeypatch.setattr(D, "BLOCK", request.param)
    monkeypatch.setattr(D, "UNIT", min(request.param, 64))


def entries(spark, n=60):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(25)] + ["common"] * 20
    rows = []
    for i in range(n):
        base = rng.choice(rows)[3].split() if i % 2 and rows else rng.sample(words, rng.randint(1, 20))
        said = " ".join(base[: len(base) - i % 3] + rng.sample(words, i % 2))
        rows.append((f"m{i:03d}", rng.choice(["one title", "a b", "", said[:20]]), rng.choice(["x", "y", None]), said, ["t"]))
    return spark.createDataFrame(rows, SCHEMA)


def test_similar_sets_are_all_pairs(spark, few):
    """F1."""
    rng = random.Random(1)
    sets = {bytes([i]): sorted({f"w{rng.randint(0, 12)}" for _ in range(rng.randint(1, 14))} | {"common"}) for i in range(80)}
    df = spark.createDataFrame([("k", k, w) for k, w in sets.items()], "kind string, key binary, words array<string>")
    want = {}
    for (a, x), (b, y) in combinations(sets.items(), 2):
        j = len(set(x) & set(y)) / len(set(x) | set(y))
        if j >= 0.67:
            want[(a, b)] = j
    got = D.similar_sets(df, 0.67).collect()
    assert len(got) == len(want) > 50 and {(bytes(r.a), bytes(r.b)): r.j for r in got} == want


def test_one_title_for_many_is_one_set(spark):
    """entries of one title meet as one set, whatever else they say."""
    rows = [(f"m{i}", "one title for many", "x", f"text{i} of{i} its{i} own{i}", []) for i in range(300)]
    keyed = D._keyed(D.prepared(spark.createDataFrame(rows, SCHEMA)))
    assert D._sets_of(keyed).filter("kind = 'title'").count() == 1
    got = D.best_matches(spark.createDataFrame(rows, SCHEMA)).collect()
    first = sorted(r[0] for r in rows)[:6]
    assert len(got) == 1500 and all(r.match in first and r.score == 1.0 for r in got)


def test_texts_are_cut_and_sets_compared_once(spark):
    """before, everything was cut again beside its parts, and sets were compared in each of four readings."""
    cut = D.prepared(entries(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert cut.count("nd}]+") + cut.count("Nd}]+") == 3
    plan = D.best_matches(entries(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and "Distinct" not in plan


def test_tokens_of_everything(spark):
    """the tokens of the parts are those of the whole, with nulls and no tags too."""
    rows = [("a", "Ένα ΛΌΓΟΣ two2", "cat egory", "x-yz one_two\nthree ΛΌΓΟΣ", ["tag", None, "other"]), ("b", None, None, None, None), ("c", "", "", "ab abc", []), ("d", "one", None, "one", ["one"])]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = F.concat_ws("\n", "title", "category", F.array_join("tags", " "), "content")
    want = {r.id: set(r.w) for r in df.select("id", F.transform(X.letter_tokens(whole), lambda t: F.xxhash64(t)).alias("w")).collect()}
    got = {r.id: r.s_all for r in D.prepared(df).select("id", "s_all").collect()}
    assert {k: set(v) for k, v in got.items()} == want and all(len(v) == len(set(v)) for v in got.values())
    assert len(want["a"]) == 10 and not want["b"]


@pytest.mark.parametrize("frequent", [1, 40, 1 << 18])
def test_pairs_do_not_depend_on_what_is_frequent(spark, monkeypatch, frequent):
    """the order of words is of no consequence, so it may know the frequent ones only."""
    monkeypatch.setattr(D, "FREQUENT", frequent)
    test_similar_sets_are_all_pairs(spark, None)


def test_topics_are_all_pairs(spark, few):
    """with many copies of a title and a token in every title."""
    rng = random.Random(3)
    titles = [" ".join(["common", *rng.sample([f"word{i}" for i in range(9)], rng.randint(0, 4))]) for _ in range(30)]
    rows = [(f"d{i}", rng.choice(titles)) for i in range(90)] + [(f"e{i}", titles[0]) for i in range(30)]
    want = set()
    for (a, x), (b, y) in combinations(sorted(rows), 2):
        n = len(set(x.split()) & set(y.split()))
        if x != y and n >= 2:
            want.add((a, b, n, round(0.82 + min((n - 2) * 0.03, 0.09), 6)))
    got = [tuple(r) for r in D.topic_conflicts(spark.createDataFrame(rows, "id string, title string")).select("a", "b", "shared", "score").collect()]
    assert len(got) == len(want) and set(got) == want


def test_topics_shuffle_lists_and_not_pairs(spark):
    """nothing is exchanged once titles have met."""
    d = spark.createDataFrame([(f"d{i}", f"common words {i % 7}") for i in range(40)], "id string, title string")
    plan = D.topic_conflicts(d)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and "Aggregate" not in plan.split("Join Inner")[0]


def test_review_is_all_pairs_of_heads(spark, few):
    """F4."""
    e = entries(spark)
    sets = D.with_heads(D.prepared(e))
    rows = sets.select("id", "head").collect()
    pairs = [(x.id, y.id) for x in rows for y in rows if x.id < y.id and (x.id == x.head and y.id == y.head or x.id == y.head)]
    want = {tuple(r) for r in D._scored(spark.createDataFrame(pairs, "a string, b string"), sets, D.THRESHOLD).collect()}
    got = [tuple(r) for r in D.review_pairs(e).collect()]
    assert len(got) == len(want) > 50 and set(got) == want
    assert not hasattr(D, "prefix_pairs")  # which formed all pairs of a frequent token
