import numpy as np
import pytest

from sparkloom import tables as T
from sparkloom.operators import cells as B
from sparkloom.operators import vector as V

SCHEMA = "vec_id long, type string, embedding array<float>"


def clustered(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 16))
    rows = [(i, ["doc", "task"][i % 2], (middles[i % 12] + 0.05 * rng.normal(size=16)).tolist()) for i in range(600)]
    rows += [(1000, "doc", [0.0] * 16), (1001, "doc", None), (1002, "task", []), (1003, "doc", [1.0, 2.0]), (1004, "doc", [2.0, 1.0])]
    rows += [(2000 + i, "doc", rows[0][2]) for i in range(20)]
    return T.stored(spark.createDataFrame(rows, SCHEMA).repartition(4), "test-vectors")


@pytest.fixture(scope="module")
def held(spark):
    rows = clustered(spark)
    cells = B.Cells(spark, T.scratch(spark, "test-cells"))
    cells.build(rows, cells=16)
    return rows, cells


@pytest.mark.parametrize("k, threshold, kind", [(10, 0.3, None), (5, 0.3, "task"), (50, -1.0, None), (3, 0.0, None)])
def test_cells_equal_the_scan(spark, held, k, threshold, kind):
    rows, cells = held
    ids = [0, 1, 2, 13, 99, 1000, 1003, 2003]
    asked = rows.filter(rows.vec_id.isin(ids)).selectExpr("vec_id AS qid", "embedding AS query")
    got = {}
    for r in cells.top_k(asked, k, threshold, kind).orderBy("qid", "place").collect():
        got.setdefault(r["qid"], []).append((r["vec_id"], r["score"]))
    for i in ids:
        want = V.top_k(rows, V.query_of(rows, i), k, threshold, kind).select("vec_id", "score").collect()
        assert got.get(i, []) == [tuple(r) for r in want]


def test_far_cells_are_left_out(spark, held):
    rows, cells = held
    asked = rows.filter("vec_id IN (0, 5)").selectExpr("vec_id AS qid", "embedding AS query")
    searched = cells.searched(asked, 10, 0.3)
    assert 0 < searched.filter("live").count() < searched.count() / 2


def test_empty_table(spark):
    cells = B.Cells(spark, T.scratch(spark, "test-cells"))
    cells.build(spark.createDataFrame([], SCHEMA))
    assert cells.top_k(spark.createDataFrame([(1, [1.0])], "qid long, query array<float>")).collect() == []
