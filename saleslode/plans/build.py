"""Layer builds: read the current state of one layer, write the next."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslode import settings as fixed
from saleslode.operators import outliers, profile
from saleslode.plans import gold, rfm, silver, suites
from saleslode.session import collect_garbage, cut_lineage
from saleslode.settings import Layout
from saleslode.sinks import writers
from saleslode.sources import lake

SILVER_SCHEMA = (
    "dataset string, source_path string, destination_path string, rows_input bigint, "
    "rows_output bigint, columns_output bigint, notes array<string>"
)


def _build_dataset(spark: SparkSession, layout: Layout, source: str, dataset: str) -> tuple:
    """Write the Silver batch of one dataset; its result row."""
    source_dir = f"{layout.bronze}/{source}/{dataset}"
    batch = lake.latest_batch(spark, source_dir)
    raw = lake.read_latest(spark, source_dir)
    typed, notes = silver.transform(source, dataset, raw)
    target = f"{layout.silver}/{source}/{dataset}"
    written = writers.append_batch(typed, target, batch)
    return (f"{source}.{dataset}", f"{source_dir}/batch_id={batch}",
            f"{target}/batch_id={batch}", raw.count(), written, len(typed.columns), list(notes))


def build_silver(spark: SparkSession, layout: Layout, with_profiles: bool = False) -> DataFrame:
    """Transform the newest batch of every dataset; the batch keeps its id.

    Returns one result row per dataset. Profiles before and after are optional, since
    each costs two further passes over the data.
    """
    rows, profiles = [], {}
    for source in fixed.SOURCES:
        for dataset in lake.datasets_below(spark, f"{layout.bronze}/{source}"):
            rows.append(_build_dataset(spark, layout, source, dataset))
            collect_garbage(spark)
            if with_profiles:
                profiles[f"{source}.{dataset}"] = tuple(
                    profile.profile_record(lake.read_latest(spark, f"{layer}/{source}/{dataset}"))
                    for layer in (layout.bronze, layout.silver)
                )
    results = spark.createDataFrame(rows, SILVER_SCHEMA)
    report = _with_profiles(results, profiles) if profiles else results
    writers.write_report(report, layout.silver, "_reports/silver_build_")
    return results


def _with_profiles(results: DataFrame,
                   profiles: Mapping[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Nest each dataset's two profiles into its result row."""
    long = None
    for dataset, (before, after) in profiles.items():
        both = before.select(
            F.lit(dataset).alias("dataset"), F.struct(*before.columns).alias("profile_before")
        ).withColumn("profile_after", after.select(F.struct(*after.columns)).scalar())
        long = both if long is None else long.unionByName(both)
    return results.join(long, "dataset", "left")


def gold_frames(sources: Mapping[str, DataFrame], series_rows: DataFrame,
                statistics: DataFrame) -> dict[str, DataFrame]:
    """All 13 datasets as lazy frames over a shared, stored orders-with-items fact.

    Daily and monthly sales and the indicators are stored as well: they are read several
    times, hold one row per day or month, and would otherwise repeat their aggregation.
    """
    facts = cut_lineage(gold.order_facts(sources["orders"], sources["order_items"]))
    sales = gold.sales_of_facts(facts)
    daily = cut_lineage(gold.sales_daily(sales))
    monthly = cut_lineage(gold.sales_monthly(sales))
    indicators = cut_lineage(gold.economic_indicators(series_rows, statistics))
    return {
        "sales_daily": daily,
        "sales_monthly": monthly,
        "category_performance": gold.category_performance(
            sources["order_items"], sources["products"],
            sources["product_category_name_translation"],
        ),
        "customer_metrics": gold.customer_metrics_of_facts(sources["customers"], facts),
        "seller_metrics": gold.seller_metrics(sources["sellers"], sources["order_items"]),
        "delivery_metrics": gold.delivery_metrics(sources["orders"]),
        "review_metrics": gold.review_metrics(sources["order_reviews"]),
        "economic_indicators": indicators,
        "sales_economic_features": gold.sales_economic_features(monthly, indicators),
        "customer_rfm": rfm.customer_rfm(sales),
        "ml_features": gold.ml_features(daily),
        "anomaly_metrics": gold.anomaly_metrics(daily),
        "dim_date": gold.dim_date_of_sales(daily),
    }


def build_gold(spark: SparkSession, layout: Layout) -> DataFrame:
    """Rebuild every Gold dataset from the current Silver; one result row each."""
    sales = lake.read_latest_below(spark, f"{layout.silver}/{fixed.SALES_SOURCE}")
    daily_series = lake.read_latest_below(spark, f"{layout.silver}/{fixed.SERIES_SOURCE}")
    statistics = lake.read_latest_below(spark, f"{layout.silver}/{fixed.STATISTICS_SOURCE}")
    columns = ("date", "value", "series_code", "indicator_name")
    series_rows = None
    for rows in daily_series.values():
        part = rows.select(*columns)
        series_rows = part if series_rows is None else series_rows.unionByName(part)
    frames = gold_frames(sales, series_rows, statistics["ipca"])
    results = [
        writers.overwrite_dataset(gold.in_output_order(name, frames[name]), layout.gold, name,
                                  grain)
        for name, grain in fixed.GOLD_GRAINS.items()
    ]
    report = writers.results_frame(spark, results)
    writers.write_report(report, layout.gold, "_reports/gold_build_")
    return report


def read_gold(spark: SparkSession, layout: Layout) -> dict[str, DataFrame]:
    """The Gold datasets that exist."""
    found = {}
    for name in fixed.GOLD_GRAINS:
        try:
            found[name] = lake.read_dataset(spark, layout.gold, name)
        except lake.DatasetNotFound:
            continue
    return found


def validate_silver(spark: SparkSession, layout: Layout) -> DataFrame:
    """Rule results of the current Silver layer; also written as a report."""
    frames = {}
    for source in fixed.SOURCES:
        frames |= lake.read_latest_below(spark, f"{layout.silver}/{source}")
    results = cut_lineage(suites.silver_results(frames))
    writers.write_report(results, layout.silver, "_quality_reports/silver_quality_")
    return results


def validate_gold(spark: SparkSession, layout: Layout) -> DataFrame:
    """Verdict of the Gold layer, with the missing datasets."""
    frames = read_gold(spark, layout)
    results = cut_lineage(suites.gold_results(frames))
    verdict = suites.layer_verdict(results, suites.missing_gold(frames))
    writers.write_report(results, layout.gold, "_quality_reports/gold_quality_")
    return verdict


def outlier_values(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Configured columns as (dataset, column, value), one scan per dataset."""
    long = None
    for dataset, df in frames.items():
        columns = [c for c in fixed.OUTLIER_COLUMNS.get(dataset, ()) if c in df.columns]
        if not columns:
            continue
        part = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
            [], columns, "column", "value"
        ).select(F.lit(dataset).alias("dataset"), "column", "value")
        long = part if long is None else long.unionByName(part)
    return long


def outlier_report(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Interquartile summary per configured (dataset, column)."""
    return outliers.iqr_summaries(
        outlier_values(frames), "value", ("dataset", "column"), few_groups=True
    )
