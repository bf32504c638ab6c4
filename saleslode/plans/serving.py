"""Reads behind the serving layer and the dashboard."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslode import settings as fixed
from saleslode.functions import (
    EXACT,
    MONEY_DIGITS,
    label_or_self,
    line_total,
    stable_sum,
    title_words,
)
from saleslode.operators.reshape import checked_limit, melt, top_rows
from saleslode.settings import Layout
from saleslode.sources import files, lake, reports

SALES_POINT = ("orders", "customers", "items_sold", "revenue", "freight_value", "gmv",
               "average_ticket")
CATEGORY_NAMES = {
    "categoria": "Categoria", "gmv": "GMV", "orders": "Pedidos", "items_sold": "Itens",
    "average_ticket": "Ticket médio",
}
ZSCORE_SUFFIX = "_zscore_anomaly"
# Items that one task holds in a hash table or sorts.
ROWS_A_TASK = 1 << 20


def latest_sales(sales: DataFrame, period: str, limit: int) -> DataFrame:
    """Newest days or months, newest first."""
    points = sales.select(F.col(period).alias("period"), *SALES_POINT)
    return top_rows(points, F.col("period").desc(), checked_limit(limit))


def top_categories(categories: DataFrame, limit: int = 10) -> DataFrame:
    return top_rows(categories, [F.col("gmv").desc(), F.col("category")], checked_limit(limit))


def category_table(categories: DataFrame, limit: int = 15) -> DataFrame:
    """Leading categories under their display names, labels in title case."""
    named = top_categories(categories, limit).withColumn("categoria", title_words(F.col("category")))
    return named.select(*CATEGORY_NAMES).withColumnsRenamed(CATEGORY_NAMES)


def any_flag(df: DataFrame, suffix: str = ZSCORE_SUFFIX) -> Column:
    """True when any column with the suffix is true."""
    flags = [F.col(name) for name in df.columns if name.endswith(suffix)]
    return F.coalesce(reduce(or_, flags), F.lit(False))


def anomaly_days(compared: DataFrame, limit: int = 50, only_overlap: bool = False) -> DataFrame:
    """Newest anomalous days: by either method, or only those both methods flag."""
    if only_overlap:
        chosen = F.col("anomaly_method_overlap")
    else:
        chosen = F.col("any_zscore_anomaly") | F.col("isolation_forest_anomaly")
    days = compared.where(chosen).select(
        "date", *fixed.ANOMALY_METRICS, "isolation_forest_anomaly", "any_zscore_anomaly",
        "anomaly_method_overlap",
    )
    return top_rows(days, F.col("date").desc(), checked_limit(limit))


def segment_summary(segments: DataFrame) -> DataFrame:
    """Customers and mean behaviour per segment, largest first; no segment is a group too."""
    return segments.groupBy("ml_segment").agg(
        F.count("customer_id").alias("customers"),
        F.avg("recency_days").alias("average_recency_days"),
        F.avg("frequency").alias("average_frequency"),
        F.try_divide(stable_sum(F.col("monetary")), F.count("monetary")).alias(
            "average_monetary"
        ),
    ).orderBy(F.col("customers").desc(), "ml_segment")


def labelled_segments(summary: DataFrame) -> DataFrame:
    """Segments with their display label; an unknown one keeps its own name."""
    return summary.withColumn("segmento", label_or_self(F.col("ml_segment"), fixed.SEGMENT_LABELS))


def segment_categories(segments: DataFrame, orders: DataFrame, items: DataFrame,
                       categorised: DataFrame) -> DataFrame:
    """Sales per (segment, category).

    Items get their category and are summed per order and category, with map-side combine;
    only these sums meet the segmented orders, so a hot order or bestseller is a few rows.
    Both sides of that join are unique, so its rows are counted without a set of orders.
    Items are dealt out by their content and sums by their order, ``ROWS_A_TASK`` a task, so
    that no hash table or sort grows with the files or with merged partitions.
    """
    tasks = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                items.count() // ROWS_A_TASK + 1)
    owned = orders.select("order_id", "customer_id").join(
        segments.select("customer_id", "ml_segment"), "customer_id"
    ).groupBy("order_id", "ml_segment").agg(F.count(F.lit(1)).alias("copies"))
    known = F.coalesce("category", F.lit(fixed.UNKNOWN_CATEGORY)).alias("category")
    sold = items.select("order_id", "product_id", "price", "freight_value").join(
        categorised, "product_id", "left"
    ).select("order_id", known, "price", "freight_value").repartition(
        tasks, "order_id", "category", "price", "freight_value"
    ).groupBy("order_id", "category").agg(
        stable_sum(line_total()).alias("gmv"), F.count(F.lit(1)).alias("items")
    )
    # Totals have four places, so the product with a count is exact.
    repeated = F.col("gmv").try_cast(EXACT) * F.col("copies")
    return sold.repartition(tasks, "order_id").join(
        owned.repartition(tasks, "order_id"), "order_id"
    ).groupBy("ml_segment", "category").agg(
        F.round(F.sum(repeated).cast("double"), MONEY_DIGITS).alias("gmv"),
        F.count(F.lit(1)).alias("orders"),
        F.sum(F.col("items") * F.col("copies")).alias("items"),
    )


def one_segment(rows: DataFrame, label: str) -> DataFrame:
    """Categories of one labelled segment, smallest sales first."""
    return labelled_segments(rows).where(F.col("segmento") == label).orderBy("gmv")


def strongest_correlation(correlations: DataFrame) -> DataFrame:
    """Pair with the largest absolute correlation; undefined ones come last."""
    size = F.abs("correlation")
    return correlations.orderBy(size.desc_nulls_last(), "metric", "indicator").limit(1)


def error_rows(metrics: DataFrame) -> DataFrame:
    """Model errors in long form with display labels."""
    long = melt(metrics, ["model_name"], ["mae", "rmse"], "metric", "value")
    return long.withColumn("metric", label_or_self(F.col("metric"), fixed.METRIC_LABELS))


def best_model(metrics: DataFrame) -> DataFrame:
    """Model with the least mean absolute error; the first listed wins a tie."""
    return metrics.agg(F.min_by("model_name", F.struct("mae", "position")).alias("best_model"))


def kpi_projection(report: DataFrame) -> DataFrame:
    """KPI row as served: renamed ticket, and the first of the leading categories."""
    return report.select(
        "period_start", "period_end", "gmv_total", "revenue_total", "orders_total",
        "customers_total", "items_sold_total",
        F.col("average_ticket_per_item").alias("average_ticket"),
        "average_freight", "active_sellers", "average_delivery_days", "average_delay_rate",
        "average_review_score", "best_month_by_gmv",
        F.try_element_at("top_categories", F.lit(1))["category"].alias("top_category_by_gmv"),
    )


def catalog(spark: SparkSession, layout: Layout) -> DataFrame:
    """Name, path, rows and columns per stored dataset, and the newest report per kind."""
    rows = []
    for kind, folder in (("gold", layout.gold), ("model_output", f"{layout.models}/outputs")):
        for entry in files.entries(spark, folder):
            if entry.is_dir and not entry.name.startswith("_"):
                df = lake.read_dataset(spark, folder, entry.name)
                rows.append((kind, entry.name, f"{folder}/{entry.name}", df.count(), df.columns))
    for kind in fixed.SERVED_REPORTS:
        layer, prefix = fixed.REPORT_KINDS[kind]
        path = reports.latest_report_path(spark, layout.folder(layer), prefix)
        if path:
            rows.append(("latest_report", kind, path, None, None))
    return spark.createDataFrame(
        rows, "kind string, name string, path string, rows bigint, columns array<string>"
    )
