import os

import pytest
from same_rows import same_rows

from tidegate.plans import catalog

SF = os.environ.get("TIDEGATE_TEST_SF", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_equals_sql(spark, name):
    same_rows(spark, SF, catalog.QUERIES[name], catalog.ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 50
    assert set(e.oracle_sql()) <= set(e.queries())
