"""Registered queries against their DuckDB statements on the smallest test data."""

import pytest
from compare import differences, open_duckdb

import __spark_entry__ as contract
from arborlens.plans import oracle, queries as registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return open_duckdb(FOLDER)


def test_every_query_has_a_statement():
    """Queries that SQL cannot express are listed where they are tested."""
    found = contract.queries()
    assert set(contract.oracle_sql()) <= set(found)
    assert set(registry.REGISTERED) == set(oracle.statements())


def test_entry(spark):
    assert contract.entry(spark).columns == ["project", "lang", "files", "tokens", "rank"]


@pytest.mark.parametrize("name", list(contract.oracle_sql()))
def test_query(spark, connection, name):
    assert differences(spark, connection, name, FOLDER) == ""
