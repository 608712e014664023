"""Queries of this package against their SQL twins on the driver tables."""

from __future__ import annotations

import pytest
from conftest import SMALL
from oracle_compare import connection, oracle_rows, spark_rows

from rollbook.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", list(ORACLE))
def test_same_rows(spark, name):
    columns, rows = spark_rows(QUERIES[name](spark, SMALL))
    expected_columns, expected = oracle_rows(connection(SMALL), ORACLE[name])
    assert columns == expected_columns
    assert expected
    assert rows == expected
