"""Every query that has SQL gives the same rows in DuckDB; the others run."""

import os

import pytest

import compare
from foliograph.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return compare.connection(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    frame = catalog.queries()[name](spark, FOLDER)
    sql = catalog.oracle_sql().get(name)
    if sql:
        assert compare.differences(frame, con, sql) == ""
    else:
        assert frame.columns and frame.count() >= 0
