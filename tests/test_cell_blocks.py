"""cells that meet their queries in many blocks give what the scan gives."""

import numpy as np

from sparkloom import tables as T
from sparkloom.operators import cells as B
from sparkloom.operators import vector as V


def test_blocks_of_vectors_and_queries_equal_the_scan(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 20)
    monkeypatch.setattr(B, "ASKED", 2)
    rng = np.random.default_rng(5)
    rows = [(i, "doc", rng.normal(size=8).tolist()) for i in range(150)]
    rows += [(200 + i, "doc", rows[0][2]) for i in range(30)] + [(300, "doc", [0.0] * 8), (301, "doc", None)]
    table = T.stored(spark.createDataFrame(rows, "vec_id long, type string, embedding array<float>"), "block-vectors")
    cells = B.Cells(spark, T.scratch(spark, "block-cells"))
    cells.build(table, cells=3)
    asked = table.filter("vec_id IN (0, 7, 300)").selectExpr("vec_id AS qid", "embedding AS query")
    got = {}
    for r in cells.top_k(asked, 6, -1.0).orderBy("qid", "place").collect():
        got.setdefault(r["qid"], []).append((r["vec_id"], r["score"]))
    for i in (0, 7, 300):
        want = V.top_k(table, V.query_of(table, i), 6, -1.0).select("vec_id", "score").collect()
        assert got[i] == [tuple(r) for r in want]
