"""Every query with SQL gives what DuckDB gives on the same tables."""

import pytest

from strandline.plans.registry import ORACLE, QUERIES
from tests.compare import connect, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_keys():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got, want = spark_rows(QUERIES[name](spark, SF)), sql_rows(con, ORACLE[name])
    assert got[0] == want[0]
    assert len(got[1]) > 0 and got[1] == want[1]
