"""Every registered query against its SQL on the smallest tables; queries without SQL must give rows."""

import pytest

import compare
from tessera.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    query, sql = registry.queries()[name], registry.oracle_sql().get(name)
    if sql is None:
        assert query(spark, SF).schema.fields
        query(spark, SF).write.format("noop").mode("overwrite").save()
    else:
        assert compare.differences(spark, query, sql, SF, con) is None


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_inventory_is_covered():
    """All operators of the design but those that need binary parsers or remote services."""
    have = {n.split("_")[0].rstrip("bc") for n in registry.queries()}
    sizes = {"A": 36, "B": 25, "C": 17, "D": 38, "E": 27, "F": 21, "G": 27, "H": 62, "S": 7, "T": 9}
    want = {f"{k}{i:02}" for k, n in sizes.items() for i in range(1, n + 1)} - {"A10", "A16", "A35", "A36"}
    assert want <= have


def test_flagship(spark):
    rows = registry.flagship(spark, SF)
    assert rows.count() > 0
    assert {"query_id", "rank", "id", "score", "sources"} <= set(rows.columns)
