"""Every registered query against its SQL equivalent."""

import os

import pytest

import __spark_entry__ as entry
import oracle
from millrace.plans import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


def test_every_query_has_sql():
    """Of the optional text operators some have none; their own tests cover them."""
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, con, name):
    assert oracle.compare(con, entry.oracle_sql()[name], entry.queries()[name](spark, FOLDER)) is None
