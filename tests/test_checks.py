"""Every registered query against its SQL twin at the smallest scale."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tools.check_sql import compare, connect

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="shared test tables absent")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert not df.isEmpty()
    else:
        assert compare(df, con, sql) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
