"""Fixed cases in Spark against the rows that are written beside them."""

import duckdb
import fixtures
import pytest


@pytest.mark.parametrize("name", sorted(fixtures.QUERIES))
def test_fixture(spark, name):
    got = fixtures.QUERIES[name](spark, "")
    want = duckdb.connect().sql(fixtures.ORACLE_SQL[name]).select(", ".join(got.columns)).fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
