"""Every query with SQL equals DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.parity import compare, connect

SF_DIR = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="tables are not here")


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, db, name):
    verdict, _ = compare(spark, db, SF_DIR, entry.queries()[name], SQL[name])
    assert verdict is None, verdict


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(SQL)))
def test_has_rows(spark, name):
    assert entry.queries()[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 4
