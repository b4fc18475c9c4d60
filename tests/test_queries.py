"""Every query beside its SQL oracle at the smallest scale."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check_queries import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = [n for n in queries() if n in oracle_sql()]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    report = compare(spark, con, name, SF)
    assert report["match"], report


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert set(entry(spark).columns) == {"title", "link", "text", "published", "language", "status"}
