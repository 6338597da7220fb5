"""Every registered query that has SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value != value:
        return None
    return value.isoformat() if hasattr(value, "isoformat") else value.item() if hasattr(value, "item") else value


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(map(plain, r))) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    expected = duck.execute(catalogue.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_plans(spark):
    q = catalogue.queries()
    plan = lambda name: q[name](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan("filter_predicate") or "GreaterThan(l_quantity" in plan("filter_predicate")
    assert "ReadSchema: struct<l_quantity:double,l_tax:double>" in plan("starmap_columns")
    assert "TakeOrderedAndProject" in plan("nlargest")
    assert "WindowGroupLimit" in plan("nlargest_by_key")
    assert "partial_sum" in plan("aggregate_by_key_sum")
    assert plan("cogroup_sizes").split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1
    assert "BroadcastHashJoin" in plan("broadcast_lookup")
