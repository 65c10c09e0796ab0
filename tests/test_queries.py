"""Every named query against its SQL at the smallest scale."""

import pytest

import oracle
from memlake import registry

PATH = "/root/testdata/sf0.001"
NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def con():
    return oracle.connect(PATH)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(name, spark, con):
    df = registry.queries()[name](spark, PATH)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        df.collect()
    else:
        assert oracle.compare(df, con, sql) is None

