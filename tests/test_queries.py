"""Every registered query with SQL equals that SQL on the smallest tables."""

import pytest

from siltstone.plans import registry
from tests.compare import compare, connect

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, con, name):
    assert compare(spark, con, registry.QUERIES[name], registry.ORACLES[name], DIR) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DIR).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and all(r["rank"] <= 3 for r in rows)
    assert all(n <= 2 for n in __import__("collections").Counter((r["item_id"], r["source"]) for r in rows).values())
