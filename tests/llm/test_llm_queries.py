"""The registered queries of the subpackage against their SQL in DuckDB."""

import pytest

import __spark_entry__ as entry
from checks.compare import differences, duck
from shelfwise.llm import queries


@pytest.fixture(scope="module")
def connection(sf_dir):
    return duck(sf_dir)


def test_all_operators_and_the_pipeline_are_registered():
    names = set(entry.queries())
    assert all(any(name.startswith(f"op{n}_") for name in names) for n in range(1, 14))
    assert "pipeline" in names and set(queries.oracle_sql()) <= names


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, connection, name):
    found = entry.queries()[name](spark, sf_dir)
    assert differences(found, connection.sql(queries.oracle_sql()[name])) is None
