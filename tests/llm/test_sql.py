"""Queries with SQL counterparts, on the smallest tables."""

import oracle
import pytest

from threadlens.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    problem = oracle.differences(spark, oracle.connect(SF), SF, QUERIES[name], ORACLE[name])
    assert problem is None, problem
