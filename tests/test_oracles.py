"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest

from incidentlab.catalog import ORACLES, QUERIES
from tools.check import compare, connect


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, data, duck, name):
    ours = QUERIES[name](spark, data).toPandas()
    assert compare(ours, duck.execute(ORACLES[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
