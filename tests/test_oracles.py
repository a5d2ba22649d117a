"""Every corpus query with a DuckDB twin gives the twin's rows; the others are held against brute force elsewhere."""

import pytest

from corpusloom.plans import catalog
from tests.compare import difference, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, con, name):
    assert difference(catalog.QUERIES[name](spark, SF), con, catalog.ORACLES[name]) == ""


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
