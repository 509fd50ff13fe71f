"""Every registered query against its SQL in DuckDB."""

import pytest

import __spark_entry__ as entry
from checks.compare import differences, duck


@pytest.fixture(scope="module")
def connection(sf_dir):
    return duck(sf_dir)


def test_every_query_has_sql():
    assert set(entry.library_queries()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(entry.library_queries()))
def test_query_equals_sql(spark, sf_dir, connection, name):
    found = entry.library_queries()[name](spark, sf_dir)
    assert differences(found, connection.sql(entry.oracle_sql()[name])) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
