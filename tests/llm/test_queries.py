"""The subpackage's queries against their SQL, on the smallest tables."""

import pytest

from sparkloka.llm import queries

from ..compare import database, rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees_with_sql(spark, tiny, name):
    assert rows_of(queries.queries()[name](spark, tiny)) == rows_of_sql(database(tiny), queries.oracle_sql()[name])
