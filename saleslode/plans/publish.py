"""Model outputs and reports of a lake, written where health checks and serving look."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslode import settings as fixed
from saleslode.plans import analytics, bronze, ml, suites
from saleslode.plans.warehouse import WAREHOUSE_INPUTS
from saleslode.session import cut_lineage
from saleslode.settings import Layout
from saleslode.sinks import writers
from saleslode.sources import files


def write_kind(df: DataFrame, layout: Layout, kind: str) -> str:
    """Write a report of one of the ``REPORT_KINDS``; returns its path."""
    layer, prefix = fixed.REPORT_KINDS[kind]
    return writers.write_report(df, layout.folder(layer), prefix)


def publish_quality(spark: SparkSession, layout: Layout, silver_frames: Mapping[str, DataFrame],
                    gold: Mapping[str, DataFrame]) -> None:
    """Check results of all three layers."""
    write_kind(bronze.validate_bronze(spark, layout), layout, "bronze_quality")
    write_kind(suites.silver_results(silver_frames), layout, "silver_quality")
    write_kind(suites.gold_results(gold), layout, "gold_quality")


def publish_analytics(layout: Layout, gold: Mapping[str, DataFrame]) -> None:
    """KPI and economic reports."""
    write_kind(analytics.kpi_report(
        *[gold[n] for n in ("sales_daily", "sales_monthly", "category_performance",
                            "delivery_metrics", "review_metrics", "seller_metrics")]),
        layout, "kpis")
    write_kind(analytics.economic_correlations(gold["sales_economic_features"]), layout,
               "economic")


def publish_models(layout: Layout, gold: Mapping[str, DataFrame], reviews: DataFrame,
                   orders: DataFrame, restarts: int = ml.RESTARTS) -> None:
    """Segments with their RFM scores, anomaly comparison, review summary, and four reports."""
    outputs = f"{layout.models}/outputs"
    segments, scores = ml.segment_customers(gold["customer_rfm"], restarts)
    writers.overwrite_dataset(segments, outputs, "customer_segments")
    write_kind(scores, layout, "segmentation")
    compared = cut_lineage(ml.compare_anomaly_methods(gold["anomaly_metrics"]))
    writers.overwrite_dataset(compared, outputs, "anomaly_method_comparison")
    write_kind(ml.anomaly_counts(compared), layout, "anomaly")
    counts = cut_lineage(analytics.review_counts(reviews, orders))
    writers.overwrite_dataset(analytics.review_summary(counts), outputs,
                              "review_intelligence_summary")
    write_kind(analytics.review_report(counts), layout, "reviews")
    write_kind(ml.train_forecast(gold["ml_features"]), layout, "forecast")


def warehouse_inputs(spark: SparkSession, layout: Layout) -> DataFrame:
    """(dataset, path, present) of the Gold datasets that the warehouse load reads."""
    rows = [(n, f"{layout.gold}/{n}", files.exists(spark, f"{layout.gold}/{n}"))
            for n in WAREHOUSE_INPUTS]
    return spark.createDataFrame(rows, "dataset string, path string, present boolean").select(
        "dataset", "path", F.coalesce("present", F.lit(False)).alias("present"))
