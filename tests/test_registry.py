"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from oracle_check import compare, connect

import __spark_entry__ as entry_points
from corpusdesk.plans import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    ok, message = compare(spark, SF_DIR, name, entry_points.queries()[name], entry_points.oracle_sql().get(name), duck)
    assert ok, message


def test_entry(spark):
    assert entry_points.entry(spark).columns


def test_only_one_query_lacks_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"chunk_chars"}
