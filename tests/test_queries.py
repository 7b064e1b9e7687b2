"""Every registered query of the engine gives DuckDB's rows."""

import pytest

from brindle import registry
from tests.conftest import DATA
from tests.oracle import assert_same, connect

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_each_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLES)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, duck):
    assert_same(registry.QUERIES[name](spark, SF), registry.ORACLES[name], duck)


@pytest.mark.parametrize("name", ["order_multi", "order_desc", "order_nulls", "limit", "limit_offset", "distinct_limit"])
def test_order(name, spark, duck):
    got = [tuple(r) for r in registry.QUERIES[name](spark, SF).collect()]
    assert got == duck.execute(registry.ORACLES[name]).fetchall()


def test_whole_order_with_nulls(spark):
    """The rows with a null come last and are compared too."""
    got = registry.QUERIES["order_nulls"](spark, SF).collect()
    assert len(got) > 40 and got[-1][1] is None
