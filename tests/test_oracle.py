"""Every registered query on the smallest tables, against its DuckDB text where it has one."""

import oracle
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert oracle.diff(df, con, ORACLES[name]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows and all(v is not None for r in rows for v in r)


def test_entry(spark):
    assert entry.entry(spark).count() == 7


def test_oracle_names_are_queries():
    assert set(ORACLES) <= set(QUERIES)
