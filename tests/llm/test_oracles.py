"""Queries that SQL can express, beside their SQL."""

import pytest

from lowtide.llm import queries
from tests import check

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    ok, message = check.compare(spark, check.duck(SMALL), name, queries.QUERIES[name], queries.ORACLES[name], SMALL)
    assert ok, message
