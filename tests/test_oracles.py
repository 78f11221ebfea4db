"""Every query of the library's own operators against its SQL, and those without SQL by their rows."""

import pytest
from oracle import agrees

from quernstone import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_agrees_with_sql(spark, sf_dir, name):
    agrees(spark, catalog.QUERIES[name], catalog.SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_without_sql_has_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
