"""The stored inverted index against the scan of lexical.keyword_search."""

import random

import pytest

from sparkloom import tables as T
from sparkloom.operators import lexical as K
from sparkloom.operators import postings as P

WORDS = ["alpha", "beta", "gamma", "delta", "order", "plan", "c", "x1", "naïve", "Token"]
QUERIES = ["alpha", "order plan", "the alpha beta", "c", "x1 x1 alpha", "plan!", "p", "/d1", "category 2", "nothing here at all", "Token", "a", ""]


def corpus(spark, n=700, seed=1, start=0):
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, k)))
    docs = [(f"dir{i % 7}/d{i}", say(4), [rng.choice(WORDS)], say(3), say(40)) for i in range(start, start + n)]
    memories = [(f"m{i}", say(4), f"category {i % 5}", [rng.choice(WORDS)], say(30), "project") for i in range(start, start + n // 3)]
    docs = spark.createDataFrame(docs, "path string, title string, tags array<string>, description string, content string")
    memories = spark.createDataFrame(memories, "id string, title string, category string, tags array<string>, content string, layer string")
    return T.stored(K.union_corpus([K.corpus(docs, "doc"), K.corpus(memories, "memory")]), "test-corpus")


def index_of(spark, *updates):
    index = P.Index(spark, T.scratch(spark, "test-index"))
    for changed, removed in updates:
        index.update(changed, removed)
    return index


@pytest.fixture(scope="module")
def both(spark):
    rows = corpus(spark)
    return rows, index_of(spark, (rows, None))


@pytest.mark.parametrize("query, few", [(q, 8 * (i % 2)) for i, q in enumerate(QUERIES)])
def test_index_equals_scan(both, query, few, monkeypatch):
    """With blocks skipped and without."""
    monkeypatch.setattr(P, "FEW", few)
    rows, index = both
    assert index.search(query, 15).collect() == K.keyword_search(rows, query, 15).collect()


def test_queries_at_once_equal_one_each(spark, both):
    rows, index = both
    asked = spark.createDataFrame(list(enumerate(QUERIES)) + [(99, None)], "qid int, query string")
    got = {}
    for r in index.search_many(asked, 5).orderBy("qid", "place").collect():
        got.setdefault(r["qid"], []).append(tuple(r)[2:])
    for i, query in enumerate(QUERIES):
        assert got.get(i, []) == [tuple(r) for r in K.keyword_search(rows, query, 5).collect()]
    every = index.search_many(asked, None).filter("qid = 1")
    assert sorted(map(tuple, every.drop("qid").collect())) == sorted(map(tuple, K.keyword_scores(rows, QUERIES[1]).collect()))


def test_kind_after_the_statistics_of_all(spark, both):
    rows, index = both
    want = [r for r in K.keyword_search(rows, "alpha plan", 2000).collect() if r["type"] == "memory"][:10]
    assert index.search("alpha plan", 10, "memory").collect() == want


def test_only_buckets_of_the_terms_are_read_and_low_blocks_skipped(spark, monkeypatch):
    monkeypatch.setattr(P, "FEW", 1)
    common = [(f"x/{i}", "", [], "", "word " * (1 + i % 3)) for i in range(3000)] + [(f"best/{i}", "rare word", ["word"], "word", "rare") for i in range(30)]
    rows = K.corpus(spark.createDataFrame(common, "path string, title string, tags array<string>, description string, content string"), "doc")
    reader = index_of(spark, (rows, None)).pinned()
    asked = T.stored(P.query_table(spark.createDataFrame([(0, "rare word")], "qid int, query string")), "asked")
    terms = reader._terms(asked)
    plan = reader.bounds(asked, terms)._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan and len(reader.buckets) < P.BUCKETS
    assert "off:smallint" not in plan.split("ReadSchema")[1].split("\n")[0]
    live = reader.live_blocks(asked, terms, 10)
    n, on = live.count(), live.filter("bound >= least").count()
    assert n >= 12 and 0 < on <= 2


def test_updates_equal_a_rebuild(spark):
    rng, first, later = random.Random(5), corpus(spark), corpus(spark, 500, 9, 400)
    gone = first.filter("id LIKE '%3'").select("type", "id")
    index = index_of(spark, (first, None), (later, gone), (first.filter("id LIKE '%13'"), None))
    now = later.join(first.filter("id LIKE '%13'").select("type", "id"), ["type", "id"], "left_anti").select(later.columns)
    now = now.unionByName(first.join(later.select("type", "id"), ["type", "id"], "left_anti").join(gone, ["type", "id"], "left_anti").select(later.columns)).unionByName(first.filter("id LIKE '%13'"))
    fresh = index_of(spark, (T.stored(now, "now"), None))
    for held in (index, None):
        if held is None:
            index.compact()
        old, new = index.pinned(), fresh.pinned()
        assert old.statistics()[0] == new.statistics()[0] and old.statistics()[1] == pytest.approx(new.statistics()[1])
        for query in rng.sample(QUERIES[:-1], 2):
            assert index.search(query, 25).collect() == fresh.search(query, 25).collect()


def test_an_update_that_failed_leaves_no_trace_and_can_be_repeated(spark, both, monkeypatch):
    rows = corpus(spark, 60)
    index = index_of(spark, (rows, None))
    before = index.search("alpha", 50).collect()
    more = corpus(spark, 40, 3, 1000)
    write = P.Index._write

    def failing(self, df, name, *rest):
        if name == "terms":
            raise RuntimeError("lost")
        write(self, df, name, *rest)

    monkeypatch.setattr(P.Index, "_write", failing)
    with pytest.raises(RuntimeError):
        index.update(more)
    monkeypatch.setattr(P.Index, "_write", write)
    assert index.search("alpha", 50).collect() == before
    pinned = index.pinned()
    index.update(more)
    assert index.search("alpha", 500).collect() == index_of(spark, (rows.unionByName(more), None)).search("alpha", 500).collect()
    assert pinned.search("alpha", 50).collect() == before  # a search goes on with what it began with


def test_empty_corpus(spark):
    index = index_of(spark, (corpus(spark, 0), None))
    assert index.search("alpha").collect() == []


def test_a_block_is_posted_in_one_piece():
    """F8, F10, F12: no single counts are shuffled, so counting is not Spark's to group."""
    texts = {"type": ["doc"] * 2, "block": [3] * 2, "off": [1, 4], "_path": ["ab", ""], "_category": ["", ""], "f_title": ["x y x", None], "f_content": ["", "y - z1"]}
    got = {r["term"]: r for r in P._made(["title", "content"])(P.pa.table(texts)).to_pylist()}
    title, content = P.FIELDS.index("title"), P.FIELDS.index("content")
    assert got["x"]["p"] == [P.packed(1, title, 2, 3)] and got["x"]["docs"] == 1
    assert got["y"]["p"] == [P.packed(1, title, 1, 3), P.packed(4, content, 1, 2)] and got["y"]["docs"] == 2
    assert sorted(got["y"]["top"]) == sorted([P.packed(0, title, 1, 3), P.packed(0, content, 1, 2)])
    assert set(got) == {"x", "y", "z1", "\x01pa", "\x01pb", "\x01pab"} and got["\x01pa"]["docs"] == 0
    with pytest.raises(ValueError):
        P.packed(0, 0, 1, 1 << P.BITS)


def test_postings_are_dealt_once_however_many_queries(spark, both):
    """by block and before they meet the queries, so hits of queries are not shuffled."""
    reader = both[1].pinned()
    asked = T.stored(P.query_table(spark.createDataFrame([(i, q) for i, q in enumerate(QUERIES)], "qid int, query string")), "asked")
    terms = reader._terms(asked)
    for found in (reader.bounds(asked, terms), reader._scored(asked, terms, None, "all", None)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(block" in plan and "hashpartitioning(qid" not in plan
