"""Every registered query beside its SQL on the smallest tables, where a selection
may be empty."""

import pytest

from lowtide.plans import ORACLES, QUERIES
from tests.check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, message = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF, allow_empty=True)
    assert ok, message


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
