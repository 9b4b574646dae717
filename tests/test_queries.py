"""Every registered query against its SQL in DuckDB, and against unwanted plans."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import compare, connect
from sigreview.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck() -> duckdb.DuckDBPyConnection:
    return connect(SF)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, duck, key):
    df = QUERIES[key](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert compare(df.toPandas(), duck.execute(ORACLES[key]).df()) == ""
