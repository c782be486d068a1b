"""Every query beside its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() >= 0
        return
    n, m, extra, missing = differences(df, con, sql)
    assert not extra and not missing, (n, m)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
