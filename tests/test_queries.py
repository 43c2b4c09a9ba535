"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracles import connect, oracle_rows, query_rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    got = query_rows(queries()[name](spark, SF))
    if name in oracle_sql():
        assert got == oracle_rows(con, oracle_sql()[name])
    assert got[1]


def test_entry(spark):
    assert entry(spark).columns[0] == "function_name"
