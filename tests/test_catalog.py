"""Every registered query against its SQL twin, and the shape of its plan."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from checks import oracle_sql
from checks.compare import differences, oracle_connection

from geoledger.plans import catalog

from .conftest import SF

QUERIES, ORACLES = {k: q for k, q in entry.queries().items() if k in catalog.QUERIES}, oracle_sql.ORACLES


@pytest.fixture(scope="module")
def duck():
    return oracle_connection(SF)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "business_count" in df.columns


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name in ORACLES:
        assert differences(df, duck, ORACLES[name]) == []
    else:
        assert df.count() > 0
