"""Every registered query against its SQL, on the smallest data set."""

import os

import pytest
from oracle import connect, mismatch

from __spark_entry__ import CATALOG, entry, oracle_sql, queries

FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
SQL = oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_of_the_catalog_has_sql():
    assert set(CATALOG) <= set(SQL) <= set(queries())


@pytest.mark.parametrize("name", list(SQL))
def test_query(spark, con, name):
    assert mismatch(queries()[name](spark, FOLDER), con, SQL[name]) is None


def test_entry(spark):
    assert entry(spark).columns == ["section", "key", "value"]
