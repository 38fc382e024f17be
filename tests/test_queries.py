"""Every registered query against its SQL; no plan contains a product join."""

from __future__ import annotations

import pytest

from checks.catalog import QUERIES
from checks.compare import connect, differences
from checks.oracle import ORACLE

FOLDER = "/root/testdata/sf0.001"

@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def check(spark, con, name):
    result = QUERIES[name](spark, FOLDER)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    problem = differences(result.toPandas(), con.execute(ORACLE[name]).df())
    assert problem is None, problem


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, con, name):
    check(spark, con, name)


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
