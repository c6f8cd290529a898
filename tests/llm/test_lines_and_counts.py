import collections
import hashlib
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import common as C
from sparkloom.llm.encoding import ByteEncoder, LibraryEncoder, held, tokenizer_path
from sparkloom.llm.line_dedup import LineRuns, drop_common_lines
from sparkloom.llm.token_counts import count_tokens

from . import helpers as H

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")


def plain_line_dedup(texts, min_docs):
    key = lambda x: x.strip(H.SPACES).translate(H.TO_LOWER)
    seen = collections.Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    common = {k for k, n in seen.items() if k and n >= min_docs}
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in common]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup_matches_brute_force(spark):
    texts = H.odd_texts()
    got = drop_common_lines(H.frame(spark), min_docs=10).orderBy("doc_id").collect()
    assert [(r.n_lines, r.n_dropped, r.text) for r in got] == plain_line_dedup(texts, 10)
    assert sum(r.n_dropped for r in got) == 14
    assert got[0].size == "clash"  # extra columns stay


def test_line_dedup_null_and_repeated_ids(spark):
    rows = [(None, "common\nown", "", "", 1, "", "", "")] * 3 + [(7, "COMMON \nown2", "", "", 1, "", "", "")] * 2
    got = drop_common_lines(H.frame(spark, [], rows), min_docs=5).collect()
    assert sorted(r.text for r in got) == ["own", "own", "own", "own2", "own2"]
    assert all(r.n_dropped == 1 for r in got)


def test_line_runs_are_levelled_and_sorted(spark):
    runs = LineRuns(spark, C.scratch(spark, "test-runs"), min_docs=4, fanout=2)
    for b in range(5):
        runs.add(H.frame(spark, ["everywhere\nbatch %d" % b]))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    counts = sorted(r._n for r in runs.totals().collect())
    assert counts == [1, 1, 1, 1, 1, 4]  # settled after the fourth: not counted again
    assert runs.common().count() == 1
    part = runs._read(runs.levels[2]).rdd.mapPartitions(lambda it: [[(r._h1, r._h2) for r in it]]).collect()
    assert all(p == sorted(p) for p in part)


def test_line_dedup_empty_table(spark):
    assert drop_common_lines(H.empty(spark)).collect() == []


def test_token_counts_match_the_library(spark):
    texts = H.odd_texts()
    cache = C.scratch(spark, "test-cache")
    got = count_tokens(H.frame(spark), WORD, cache, limit=100).orderBy("doc_id").collect()
    library = LibraryEncoder(WORD)
    want = [len(x) for x in library.encode([t or "" for t in texts])]
    assert [r.n_tokens for r in got] == want
    assert [r.n_bytes for r in got] == [len((t or "").encode()) for t in texts]
    assert [r.over_limit for r in got] == [n > 100 for n in want]
    assert got[0].size == "clash" and got[5].text == texts[5]
    short = count_tokens(H.frame(spark), WORD, cache, texts=False)
    assert "text" not in short.columns and [r.n_tokens for r in short.orderBy("doc_id").collect()] == want
    assert count_tokens(H.empty(spark), WORD, C.scratch(spark, "c")).collect() == []


def test_token_cache_encodes_misses_only(spark):
    cache = C.scratch(spark, "test-cache")
    count_tokens(H.frame(spark, ["a b", "a  b", "c"]), WORD, cache)
    files = spark.read.parquet(cache + "/*")
    assert files.count() == 2  # white space runs are one content
    count_tokens(H.frame(spark, ["a\nb", "d"]), WORD, cache)
    assert spark.read.parquet(cache + "/*").count() == 3
    # a cached count is used as it is
    poisoned = files.selectExpr("_digest", "n_tokens + 100 AS n_tokens").limit(0)
    poisoned.write.mode("append").parquet(cache + "/" + "0" * 32)
    assert {r.n_tokens for r in count_tokens(H.frame(spark, ["c"]), WORD, cache).collect()} == {1}


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_space_runs_never_change_word_counts(text):
    import re

    library = held(LibraryEncoder, WORD)
    a, b = library.encode([text, re.sub(r"[\x20\x09-\x0D]+", " ", text).strip(" ")])
    assert len(a) == len(b)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=20), st.sampled_from(["<|endoftext|>", "  ", "\n ", "'s", " don't", "\x85", "\x1c", "é", "٣", "漢字"])), max_size=6))
def test_byte_ids_equal_the_library(parts):
    text = "".join(parts)
    both = held(ByteEncoder, BYTE)
    assert both.encode([text])[0].tolist() == held(LibraryEncoder, BYTE).encode([text])[0]


def test_digests_used_by_queries_agree_with_python(spark):
    from pyspark.sql import functions as F

    text = "é line\nß"
    row = spark.range(1).select(F.sha2(F.lit(text), 256).alias("s"), F.crc32(F.encode(F.lit(text), "UTF-8")).alias("c")).first()
    assert row.s == hashlib.sha256(text.encode()).hexdigest() and row.c == zlib.crc32(text.encode())
