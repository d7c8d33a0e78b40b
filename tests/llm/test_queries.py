"""Queries with SQL twins against them, on whole tables; every operator has a query."""

from __future__ import annotations

import pytest

from checks.compare import differences, oracle_connection
from geoledger.llm import queries

from ..conftest import SF


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), oracle_connection(SF), queries.ORACLES[name]) == []


def test_all_are_there():
    import __spark_entry__ as entry

    numbers = sorted(int(n.split("_")[0][2:]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
