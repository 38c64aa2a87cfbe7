"""Every registered query against the SQL that defines it, on the smallest supplied tables."""

import pytest
from compare import database, difference

from __spark_entry__ import entry, oracle_sql, queries

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def connection(data):
    return database(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, connection, name):
    if name in SQL:
        assert difference(spark, connection, QUERIES[name], SQL[name], data) is None
    else:
        assert QUERIES[name](spark, data).count() > 0


def test_entry_and_names(spark):
    assert set(SQL) <= set(QUERIES)
    assert entry(spark).count() > 0
