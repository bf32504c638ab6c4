"""Plan shapes and hot keys: what must still hold when the tables are large."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from saleslode.catalogue import all_queries
from saleslode.operators.keys import flag_duplicate_keys, orphan_rows
from saleslode.operators.rules import evaluate, unique_key
from saleslode.plans import analytics, gold

FOLDER = os.environ.get("CHECK_DIR", "/root/testdata/sf0.001")
shipped = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="table set not present")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def below_exchange(plan: str, pattern: str) -> bool:
    """The pattern occurs deeper than the first shuffle."""
    shuffle = plan.find("Exchange hashpartitioning")
    return shuffle >= 0 and re.search(pattern, plan[shuffle:]) is not None


@shipped
@pytest.mark.parametrize("name", [
    "a1_sales_daily", "a2_sales_monthly", "a3_category_performance", "a4_customer_metrics",
    "a5_seller_metrics", "a6_delivery_metrics", "a7_review_metrics", "a9_economic_indicators",
    "w9_duplicate_keys", "j8_reviews_with_orders", "q5_relationship", "j13_segment_categories",
])
def test_no_nested_loops_and_partial_aggregation(spark, name):
    plan = plan_of(all_queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name != "j8_reviews_with_orders":
        assert below_exchange(plan, r"partial_|keys=\[")


@shipped
def test_scans_read_only_what_they_need(spark):
    plan = plan_of(all_queries()["a1_sales_daily"](spark, FOLDER))
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_tax:double>" in plan
    assert "IsNotNull(o_orderdate)" in plan
    one = plan_of(all_queries()["u1_series_union"](spark, FOLDER))
    assert "EqualTo(l_returnflag,A)" in one


def test_one_order_owning_most_items(spark):
    """All items of the hot order meet the join as one row."""
    orders = spark.range(50).select(
        F.col("id").alias("order_id"), (F.col("id") % 7).alias("customer_id"),
        F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, cast(id % 5 as int))").alias(
            "order_purchase_timestamp"),
    )
    items = spark.range(30_000).select(
        F.when(F.col("id") < 20_000, F.lit(3)).otherwise(F.col("id") % 50).alias("order_id"),
        F.lit(1.0).alias("price"), F.lit(0.5).alias("freight_value"),
    )
    sales = gold.order_sales(orders, items)
    assert sales.count() == 50
    assert gold.sales_daily(sales).agg(F.sum("gmv"), F.sum("items_sold")).first()[:] == (
        45_000.0, 30_000)


def test_hot_duplicate_key_and_hot_orphan(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") < 12_000, F.lit(-1)).otherwise(F.col("id")).alias("k")
    )
    flagged = flag_duplicate_keys(rows, ["k"])
    assert flagged.where("is_duplicate_key").count() == 12_000
    assert evaluate(rows, [unique_key("k")]).first()["failed_count"] == 12_000
    found = orphan_rows(rows, "k", rows.where("k >= 0"), "k").first()
    assert (found["failed_count"], found["total_count"]) == (12_000, 30_000)
    assert "Window" not in plan_of(flagged)


def test_review_texts_are_not_shuffled(spark):
    reviews = spark.range(1_000).select(
        F.col("id").alias("review_id"), F.lit(1).alias("order_id"),
        (F.col("id") % 5 + 1).alias("review_score"),
        F.repeat(F.lit("x"), 500).alias("review_comment_message"),
    )
    orders = spark.range(3).select(
        F.col("id").alias("order_id"),
        F.lit("2024-01-02").cast("timestamp_ntz").alias("order_delivered_customer_date"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("order_estimated_delivery_date"),
    )
    counts = analytics.review_counts(reviews, orders)
    shuffled = [line for line in plan_of(counts).splitlines() if "Exchange" in line]
    assert shuffled and not any("comment" in line for line in shuffled)
    assert {r["reviews"] for r in counts.collect()} == {200}
