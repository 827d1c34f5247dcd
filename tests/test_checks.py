"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

from mailsieve.checks import load
from mailsieve.checks.run import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, SQL = load()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert name in SQL
    assert compare(spark, con, name, QUERIES[name], SQL[name], SF) is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_no_query_joins_everything_with_everything(spark):
    skipped = {n for n in QUERIES if "stream" in n}
    for name in sorted(set(QUERIES) - skipped):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
