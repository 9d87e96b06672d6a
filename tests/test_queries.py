"""Every query against its SQL; those without SQL run."""

import pytest
from oracle import same

from graftwork.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    if name in catalog.ORACLES:
        same(spark, catalog.QUERIES[name], catalog.ORACLES[name], SF)
    else:
        assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
