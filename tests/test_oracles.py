"""Every query with SQL against DuckDB, at the smallest scale."""

import pytest

from __spark_entry__ import oracle_sql, queries
from check_oracles import BRUTE_FORCE, compare, oracle_connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SF)


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_every_other_query_has_sql():
    assert not [n for n in queries() if n not in oracle_sql() and not n.startswith(BRUTE_FORCE)]


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, connection, name):
    good, note = compare(spark, connection, name, SF)
    assert good, note
