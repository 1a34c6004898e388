"""Every registered query with SQL must equal that SQL on the smallest given tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    ok, _, note = compare(spark, con, name, queries()[name], SQL[name], SF)
    assert ok, note


@pytest.mark.parametrize("name", sorted(set(queries()) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert not queries()[name](spark, SF).isEmpty()


def test_entry(spark):
    assert entry(spark).count() > 0
