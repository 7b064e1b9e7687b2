"""Plans are those the queries are meant to have."""

import pytest
from pyspark.sql import functions as F

from brindle import registry
from brindle.operators import joins as J
from brindle.plans.catalogue import _bounded_relations
from brindle.sources.tables import scan
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name, node", [("join_forced_merge", "SortMergeJoin"), ("join_forced_hash", "ShuffledHashJoin"), ("join_forced_broadcast", "BroadcastHashJoin")])
def test_forced_joins(spark, name, node):
    assert node in plan(registry.QUERIES[name](spark, SF))


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(registry.QUERIES["tpch_like_q6"](spark, SF))
    assert "GreaterThanOrEqual(l_discount,0.05)" in text and "l_comment" not in text
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double,l_shipdate:timestamp_ntz>" in text


def test_where_equality_becomes_a_join_condition(spark):
    text = plan(registry.QUERIES["join_from_where"](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "GreaterThan(o_totalprice,200000.0)" in text


def test_sort_and_limit_become_top_k(spark):
    assert "TakeOrderedAndProject" in plan(registry.QUERIES["tpch_like_q3"](spark, SF))


@pytest.mark.parametrize("name", ["group_by", "select_distinct", "agg_count_star"])
def test_aggregates_are_partial_first(spark, name):
    assert plan(registry.QUERIES[name](spark, SF)).count("HashAggregate") >= 4  # each twice: tree and details


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_python_in_plans(name, spark):
    text = plan(registry.QUERIES[name](spark, SF))
    assert not any(w in text for w in ("Python", "Pandas", "Arrow"))


def test_greedy_order(spark):
    links = [("r1", "r2", "a"), ("r2", "r3", "b"), ("r3", "r4", "c")]
    assert J.greedy_order(_bounded_relations(spark), links) == ["r2", "r3", "r4", "r1"]


def test_broadcast_only_below_the_bound(spark):
    left, right = scan(spark, SF, "orders"), scan(spark, SF, "customer")
    on = F.col("o_custkey") == F.col("c_custkey")
    assert "BroadcastHashJoin" in plan(J.broadcast_checked(left, right, on))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan(J.broadcast_checked(left, right, on, most=10))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
