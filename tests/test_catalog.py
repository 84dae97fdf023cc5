"""Every catalogue query against its SQL on the smallest tables, and what the plans of all its jobs must not contain."""

import re

import pytest

from oracle_check import compare, connect
from redpencil.plans import catalog, oracles

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), oracles.oracle_sql()


@pytest.fixture(scope="module")
def database():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def plans_since(spark, known):
    """The plans of all executions that the session has seen after ``known`` ones, as far as it keeps them."""
    store = spark._jsparkSession.sharedState().statusStore()
    return [e.physicalPlanDescription() for e in (store.executionsList().apply(k) for k in range(store.executionsCount())) if e.executionId() > known]


def last_execution(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    count = store.executionsCount()
    return store.executionsList().apply(count - 1).executionId() if count else -1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    before = last_execution(spark)
    df = QUERIES[name](spark, FOLDER)
    assert compare(df, database, ORACLES[name]) is None
    for plan in plans_since(spark, before):
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython", plan)


def test_entry(spark):
    assert catalog.flagship(spark, FOLDER).columns[:2] == ["concept", "action"]
