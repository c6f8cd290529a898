"""Results that differed from SQL on larger tables."""

import math

from pyspark.sql import functions as F

from sparkloom.operators import codesearch as Q
from sparkloom.operators import search as S
from sparkloom.operators import trigrams as G
from sparkloom.operators import vector as V


def test_equal_symbols_go_by_id(spark, tmp_path):
    """the twenty best of copies that differ in nothing but the id."""
    fields = "name kind container signature path package comments relationships".split()
    rows = [(i, *["steel token" if f == "name" else f for f in fields]) for i in (*range(40, 0, -1), *range(41, 90))]
    s = spark.createDataFrame(rows, "id long, " + ", ".join(f"{f} string" for f in fields)).repartition(7)
    want = list(range(1, 21))
    assert [r.id for r in Q.code_search(s, "steel").collect()] == want
    assert [r.id for r in G.Index(spark, f"file://{tmp_path}/index").build(s).search("steel").collect()] == want


def test_all_chunks_over_the_threshold_count_for_one_kind(spark):
    """sources whose further chunks lie beyond the 2 * limit best."""
    rows = [(i, "doc", f"src-{i % 30:02d}", "", [1.0, 0.001 * i]) for i in range(90)]
    chunks = spark.createDataFrame(rows, "vec_id long, type string, source string, header_path string, embedding array<float>")
    corpus = spark.createDataFrame([], "type string, id string, title string, path string, category string, tags array<string>, f_title string")
    got = {r.source: r.score for r in S.search(corpus, chunks, "x", [1.0, 0.0], "semantic", "doc").collect()}
    want = {r.source: r.score for r in V.roll_up(V.top_k(chunks, [1.0, 0.0], None)).collect()}
    assert len(got) == 20 and all(want[s] == x for s, x in got.items())


def test_rounding_keeps_the_sign_of_zero(spark):
    """F7."""
    rows = [(-3e-7,), (3e-7,), (-0.1234565,), (2.5e-6,), (1e20,), (0.0,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x double").select(V.rounded(F.col("x"))).collect()]
    want = [math.copysign(math.floor(abs(x) * 1e6 + 0.5) / 1e6, x) if x < 1e9 else x for x, in rows]
    assert got == want and math.copysign(1, got[0]) == -1
