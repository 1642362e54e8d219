"""Every core query against its SQL, on the smallest tables."""

import pytest

from sparkloka import catalogue

from .compare import database, rows_of, rows_of_sql

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(tiny):
    return database(tiny)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, tiny, con, name):
    assert rows_of(QUERIES[name](spark, tiny)) == rows_of_sql(con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, tiny, name):
    assert QUERIES[name](spark, tiny).limit(5).count() >= 0


def test_entry(spark, tiny):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
