"""Every query with a SQL twin equals it on the smallest supplied tables."""

import os

import oracle
import pytest

from fernlake import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = list(catalog.queries())


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    sql = catalog.oracle_sql()[name]
    assert oracle.compare(con, df, sql) == ""
    assert con.sql(sql).limit(1).fetchall(), "both are empty"


def test_oracles_name_queries():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
