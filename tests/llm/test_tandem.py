import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import tandem as T

from . import helpers as H

FIELDS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def brute_runs(w, times=2, least=2):
    """(start, length, period) of every maximal run, by comparing words."""
    out = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(least, times * p):
                out.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    # an interval's smallest period comes first; a run of it that a shorter period also has is that run
    return sorted((s, n, p) for (s, n), p in out.items())


def brute_row(doc, text):
    words = H.words(text)
    n, h = len(words), zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words, 4, 6)
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + m for s, m, p in runs)]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    listed = "".join("%d,%d,%d\n" % r for r in runs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(listed), sha(" ".join(kept)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=30), st.integers(1, 7), st.integers(0, 6))
def test_runs_match_brute_force(base, period, times):
    for w in (base, base[:5] + base[:period] * times + base):
        assert [tuple(r) for r in T.runs_of(np.array(w, np.int64)).tolist()] == brute_runs(w)


@pytest.mark.parametrize("w", [[0] * 200, [0, 1] * 150, [0, 1, 1] * 60 + [0] * 9, list("abaababaabaababaababaabaababaabaab")])
def test_periodic_and_fibonacci_words(w):
    assert [tuple(r) for r in T.runs_of(np.unique(w, return_inverse=True)[1]).tolist()] == brute_runs(w)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), max_size=25), st.integers(1, 20), st.integers(0, 7)), max_size=5), st.sampled_from([(4, 6), (2, 2), (3, 12)]))
def test_parts_hold_every_run_whole(docs, rule):
    times, least = rule
    docs = [base + base[:period] * n + base[:2] for base, period, n in docs]
    off = np.cumsum([0, *map(len, docs)])
    word = np.array([w for d in docs for w in d], np.uint64)
    parts = T.candidate_parts(word, off, times, least)
    assert all(b <= c for (_, b), (c, _) in zip(parts.tolist(), parts.tolist()[1:]))
    for at, doc in zip(off, docs):
        for s, n, _ in brute_runs(doc, times, least):
            assert any(a <= at + s and at + s + n <= b for a, b in parts.tolist())


def test_documents_match_brute_force(spark):
    docs = H.documents(spark)
    got = [tuple(r) for r in T.periodic_runs(docs, planted=True).select(*FIELDS).collect()]
    want = [brute_row(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(got) == sorted(want) and sum(r[1] > 0 for r in got) > 5


def test_odd_texts_match_brute_force(spark):
    texts = [*H.odd_texts(), "a a a a a a", "a a a a a", "x " * 50 + "y x " * 40, "one two three four\n" * 30, "p q r s " * 4 + "p q r", "End\tend END end end end end end end"]
    rng = random.Random(1)
    for _ in range(30):
        unit = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 40))]
        texts.append(" ".join([rng.choice("abcdefgh") for _ in range(rng.randint(0, 50))] + unit * rng.randint(3, 6) + unit[: rng.randint(0, 9)]))
    got = [tuple(r) for r in T.periodic_runs(H.frame(spark, texts), planted=True).select(*FIELDS).collect()]
    assert sorted(got) == sorted(brute_row(i, t) for i, t in enumerate(texts))


def test_runs_themselves_nulls_repeats_and_empty(spark):
    rows = [(None, "go on " * 4, "en", "s", 1, "c", "c", "c")] * 2 + [(3, None, "en", "s", 1, "c", "c", "c")]
    out = T.periodic_runs(spark.createDataFrame(rows, H.SCHEMA), planted=True).collect()
    assert [[tuple(x) for x in r["runs"]] for r in out if r["doc_id"] is None] == [[(0, 8, 2)]] * 2
    assert [r["runs"] for r in out if r["doc_id"] == 3] == [[]]
    assert T.periodic_runs(H.empty(spark)).isEmpty()
    lower = T.periodic_runs(spark.createDataFrame([("x", "a b a b a")], "doc_id string, text string"), times=2, least=4).first()
    assert (lower["start"], lower["length"], lower["period"], lower["exponent_milli"]) == (0, 5, 2, 2500)


def test_very_long_texts(spark):
    rng = random.Random(2)
    unit = " ".join(str(rng.random()) for _ in range(30_000))
    texts = ["word " * 400_000, " ".join([unit] * 5 + ["end"]), "x" * 5_000_000, " ".join(str(rng.random()) for _ in range(200_000))]
    frame = spark.createDataFrame([(1 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_runs"], r["start"], r["length"], r["period"]) for r in T.periodic_runs(frame).collect()}
    assert got == {1: (1, 0, 400_000, 1), 2: (1, 0, 150_000, 30_000), 3: (0, None, None, None), 4: (0, None, None, None)}
