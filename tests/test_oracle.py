"""Every registered query against its SQL twin on the driver tables."""

from __future__ import annotations

import pytest
from conftest import SMALL
from oracle_compare import connection, oracle_rows, spark_rows

import __spark_entry__ as driver
from rollbook.plans.catalogue import QUERIES
from rollbook.plans.oracle import ORACLE


UNWANTED = ("EvalPython", "InPandas", "InArrow", "Cartesian", "BroadcastNestedLoop", "Window")


@pytest.fixture(scope="module")
def con():
    return connection(SMALL)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(driver.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows(spark, con, name):
    """The rows agree, and the plan stays with built-in operators and equi-joins."""
    df = driver.queries()[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in UNWANTED:
        assert node not in plan
    columns, rows = spark_rows(df)
    expected_columns, expected = oracle_rows(con, driver.oracle_sql()[name])
    assert columns == expected_columns
    assert expected
    assert rows == expected


def test_entry(spark):
    assert driver.entry(spark).count() > 0
