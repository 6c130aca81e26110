"""Every registered query against its SQL counterpart on the smallest tables."""

import oracle
import pytest

import __spark_entry__ as entry_points
from checks import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLE:
        problem = oracle.differences(spark, con, SF, QUERIES[name], ORACLE[name])
        assert problem is None, problem
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    df = entry_points.entry(spark)
    assert "transcript" in df.columns and df.count() > 0
    assert set(entry_points.oracle_sql()) < set(entry_points.queries())
