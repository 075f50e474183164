"""Every registered query against its SQL in DuckDB, all rows."""

import os

import pytest

import __spark_entry__ as driver
import oracle
from ward_analytics.plans import oracles
from ward_analytics.plans.queries import REGISTRY

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = REGISTRY
ORACLES = oracles.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    assert oracle.spark_types(df) == oracle.duckdb_types(con, ORACLES[name])
    columns, rows = oracle.spark_rows(df)
    expected_columns, expected_rows = oracle.duckdb_rows(con, ORACLES[name])
    assert columns == expected_columns
    assert rows == expected_rows
    assert rows


def test_entry_runs(spark):
    assert driver.entry(spark).count() > 0


BANNED = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow")


#: What these return is read back from a table or a state that the query wrote; to plan them is to run them.
WRITTEN = {
    "stream_scores", "score_table", "stream_late", "live_newest", "accounted_scores", "late_readings", "live_assessments", "csv_replay",
    "scores_published", "gate_refused",
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITTEN))
def test_plan_has_no_cross_join_and_no_python(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in BANNED if word in plan]
