"""Every registered query against its checking SQL on the smallest scale."""

import pytest
from oracle_check import compare, connection

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    ok, _, message = compare(spark, con, SF, QUERIES[name], ORACLES.get(name))
    assert ok, message


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
