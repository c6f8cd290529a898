"""Every query that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from sparkloom.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

registry.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(frame, columns):
    def one(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if v is None or str(v) in ("NaT", "nan", "None", "<NA>"):
            return None
        return round(v, 6) if isinstance(v, float) else str(v)

    return sorted((tuple(map(one, r)) for r in frame[columns].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), duck.sql(registry.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = plain(got, columns), plain(want, columns)
    same = [x == y or all(p == q or isinstance(p, float) and isinstance(q, float) and abs(p - q) < 2e-6 for p, q in zip(x, y)) for x, y in zip(a, b)]
    assert len(a) == len(b) and all(same)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_partition_count_changes_nothing(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    names = ["rrf_fusion", "time_report_label", "field_diff", "near_dup_review", "historical_regroup"]
    want = {n: plain(f := registry.QUERIES[n](spark, DATA).toPandas(), sorted(f.columns)) for n in names}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        for n in names:
            got = registry.QUERIES[n](spark, DATA).toPandas()
            assert plain(got, sorted(got.columns)) == want[n]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
