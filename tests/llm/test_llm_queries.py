"""Operators' queries against their SQL."""

import pytest
from compare import duck_rows, spark_rows

from lodestone.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    assert spark_rows(queries.QUERIES[name](spark, sf_dir)) == duck_rows(duck, queries.ORACLES[name])


def test_registered(spark):
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert {n.split("_")[0] for n in queries.QUERIES if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
