"""Every training-data query with SQL gives what DuckDB gives on the smallest tables."""

import pytest

from tests.compare import connect, normal
from voxloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    got = normal(queries.queries()[name](spark, sf).toPandas())
    assert got == normal(connect(sf).execute(queries.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_without_sql_runs(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    assert df.columns and df.count() >= 0
