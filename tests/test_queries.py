"""Every driver-facing query against its SQL counterpart, and the shape of the plans."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402

from fenestra.plans.oracles import oracle_sql  # noqa: E402
from fenestra.plans.queries import all_queries  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
SQL = oracle_sql()
QUERIES = all_queries()


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(SF)


def planned(spark, name):
    """The query's DataFrame, after a look at its joins."""
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    return df


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, connection, name):
    assert oracle.compare(connection, planned(spark, name), SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, name):
    assert planned(spark, name).count() > 0


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)
