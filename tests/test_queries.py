"""Every query outside the training-data operators against its SQL."""

import pytest
from compare import duck_rows, spark_rows

from lodestone.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    assert spark_rows(catalog.QUERIES[name](spark, sf_dir)) == duck_rows(duck, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_queries_without_sql_run(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
