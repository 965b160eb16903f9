"""The physical plans stay distributed, pruned and hash-aggregated."""

import re

import pytest

from tillscope.operators import audits, baskets, lines
from tillscope.plans import registry
from tillscope.sources.driver_tables import raw_receipt_lines

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def normal(spark):
    return lines.normalize_lines(raw_receipt_lines(spark, SF))


def test_scans_read_only_what_is_used(normal):
    plan = plan_of(audits.margin_leakage(normal))
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert not any("l_partkey" in r or "l_quantity" in r or "o_orderdate" in r for r in read)


def test_basket_aggregation_hashes_before_the_shuffle(spark, normal):
    plan = plan_of(baskets.basket_features(lines.line_price_features(normal)))
    assert plan.count("HashAggregate(keys=[") >= 2 and "partial_sum" in plan
    assert "BroadcastHashJoin" in plan  # the price table was measured and is small
    assert "SinglePartition" not in plan.replace("BroadcastExchange", "")


@pytest.mark.parametrize("name", ["margin_leakage", "cashier_fingerprint", "lines_per_receipt", "hash_sample"])
def test_no_single_partition_exchange(spark, name):
    assert "SinglePartition" not in plan_of(registry.QUERIES[name](spark, SF))


def test_plans_have_no_cartesian_product(spark):
    for name in ("mission_insights", "b2b_audit", "cashier_sweethearting", "produce_weighing_errors"):
        plan = plan_of(registry.QUERIES[name](spark, SF))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
