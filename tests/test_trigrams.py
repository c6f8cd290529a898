"""Code search by the index of parts of words against the scan of all symbols."""

import random

from sparkloom.operators import codesearch as Q
from sparkloom.operators import trigrams as G

FIELDS = ["name", "kind", "container", "signature", "path", "package", "comments", "relationships"]
WORDS = ["token", "tokenizer", "broken", "to", "kent", "login", "Session", "x9", "é", "a-b"]


def symbols(spark, n=700):
    rng = random.Random(1)
    some = lambda: rng.choice([None, "", *(" ".join(rng.sample(WORDS, 2)) for _ in range(4))])
    rows = [(i, *[some() for _ in FIELDS]) for i in range(n)]
    return spark.createDataFrame(rows + rows[:5], "id long, " + ", ".join(f"{f} string" for f in FIELDS))


def test_search_equals_the_scan(spark, tmp_path):
    s = symbols(spark)
    index = G.Index(spark, f"file://{tmp_path}/index").build(s)
    for query in ("token", "oken to session", "x9 x9 nothing"):
        scores = lambda d: sorted((r.id, r.score) for r in d.select("id", "score").collect())
        want = scores(Q.code_search(s, query, 10_000))
        assert want and scores(index.search(query, 10_000)) == want
    assert index.search("- é").count() == 0
    terms = ["token", "enizer", "e", "ok", "absent", "kento"]
    text = [r[0] for r in s.select(Q.everything()).collect()]
    got = {r.term: r.symbols for r in index.frequencies(terms).collect()}
    assert got == {t: n for t in terms if (n := sum(t in x for x in text))}
    assert index.candidates(["tokenizer"]).count() < len(text)
    assert "In(part, [" in index.candidates(["tokenizer"])._jdf.queryExecution().toString()


def test_empty_table(spark, tmp_path):
    index = G.Index(spark, f"file://{tmp_path}/none").build(symbols(spark).limit(0))
    assert index.search("token").count() == 0 and index.frequencies(["token"]).count() == 0
