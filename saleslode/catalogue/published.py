"""A whole lake from the given tables: outputs, reports and the checks that look for them."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslode import settings as fixed
from saleslode.catalogue.gold import whole_gold
from saleslode.catalogue.quality import silver_frames
from saleslode.catalogue.sqltext import oracle
from saleslode.plans import bronze, build, monitoring, publish
from saleslode.session import scratch_path
from saleslode.settings import Layout
from saleslode.sinks import writers


def _lake(spark: SparkSession) -> Layout:
    base = scratch_path(spark, "published")
    return Layout(f"{base}/data", f"{base}/models")


def _with_gold(spark: SparkSession, folder: str) -> Layout:
    layout = _lake(spark)
    frames = whole_gold(spark, folder)
    for name, grain in fixed.GOLD_GRAINS.items():
        writers.overwrite_dataset(frames[name], layout.gold, name, grain)
    return layout


def _health(spark: SparkSession, folder: str) -> DataFrame:
    """All 25 checks after everything was written; a dataset's rows are counted by reading it."""
    layout = _with_gold(spark, folder)
    gold = build.read_gold(spark, layout)
    silver = silver_frames(spark, folder)
    loaded = bronze.with_load_metadata(silver["sellers"], "olist", "olist_first",
                                       datetime.now(UTC), "sellers.csv")
    writers.append_batch(loaded, f"{layout.bronze}/olist/sellers", "olist_first")
    publish.publish_quality(spark, layout, silver, gold)
    publish.publish_analytics(layout, gold)
    publish.publish_models(layout, gold, silver["order_reviews"], silver["orders"])
    checks = monitoring.health_checks(spark, layout)
    return checks.select("name", "status", F.col("details.rows").alias("rows"))


def _inputs(spark: SparkSession, folder: str) -> DataFrame:
    """The seven inputs of the warehouse load, all written."""
    return publish.warehouse_inputs(spark, _with_gold(spark, folder)).select("dataset", "present")


QUERIES = {"k11_published_health": _health, "k13_warehouse_inputs": _inputs}

_COUNTED = {
    "gold_sales_daily": "g_sales_daily", "gold_sales_monthly": "g_sales_monthly",
    "gold_category_performance": "g_category", "gold_customer_metrics": "g_customers",
    "gold_seller_metrics": "g_sellers", "gold_economic_indicators": "g_indicators",
    "gold_customer_rfm": "g_rfm", "gold_dim_date": "g_dim_date",
    "gold_delivery_metrics": "g_delivery", "gold_review_metrics": "g_reviews",
    "gold_sales_economic_features": "g_features", "gold_ml_features": "g_ml_features",
    "gold_anomaly_metrics": "g_anomalies", "model_output_customer_segments": "g_rfm",
    "model_output_anomaly_method_comparison": "g_anomalies",
    "model_output_review_intelligence_summary":
        "(select distinct review_score, coalesce(d.order_delivered_customer_date"
        " > d.order_estimated_delivery_date, false) as late"
        " from lg_reviews r left join lg_delivered d on r.order_id = d.order_id) x",
}

ORACLES = {
    "k11_published_health": oracle(" union all ".join(
        [f"select '{name}' as name, 'passed' as status, (select count(*) from {table}) as rows"
         for name, table in _COUNTED.items()]
        + [f"select 'report_{kind}', 'passed', cast(null as bigint)"
           for kind in fixed.REPORT_KINDS])),
    "k13_warehouse_inputs": " union all ".join(
        f"select '{name}' as dataset, count(*) > 0 as present from orders"
        for name in publish.WAREHOUSE_INPUTS),
}
