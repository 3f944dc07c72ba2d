"""Every registered query of the engine against DuckDB on the same tables."""

import pytest

from sparkloom import registry


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_matches_duckdb(name, spark, small, duck, same):
    got = registry.queries()[name](spark, small).toPandas()
    same(got, duck.execute(registry.oracle_sql()[name]).df())


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_entry_is_importable(spark):
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["l_orderkey", "l_extendedprice", "l_discount", "o_orderdate"]
