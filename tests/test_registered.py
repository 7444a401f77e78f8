"""Every registered query with an SQL equivalent agrees with it."""

import pytest

import __spark_entry__ as entry
from compare import connect, differences

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, connection, name):
    assert differences(QUERIES[name](spark, sf_dir), ORACLES[name], connection) == []


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_is_the_flagship(spark):
    assert entry.entry(spark).count() == 5
