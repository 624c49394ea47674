"""Every registered query next to its SQL, on the smallest given tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.skipif(not Path(SF).exists(), reason="the given tables are not here")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    note, ok = compare(spark, con, SF, name, QUERIES[name], SQL.get(name))
    assert ok or note == "rows=0", note


def test_entry(spark):
    assert entry.entry(spark).count() == 8


def test_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
