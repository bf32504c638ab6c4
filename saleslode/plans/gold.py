"""Gold business datasets.

The item table is the largest input. Everything that needs orders and items starts
from ``order_sales``: items are summed per order with map-side combine before they
are shuffled, so an order holding a large share of all items reaches the join as one
row, and the join meets one item row per order. Sums, counts and means over items
stay exact because every partial carries its own counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleslode import settings as fixed
from saleslode.functions import (
    MONEY_DIGITS,
    calendar_columns,
    day_distance,
    line_total,
    mean_from,
    month_of,
    stable_mean,
    stable_sum,
    sum_when,
    to_day,
)
from saleslode.operators import outliers, series
from saleslode.operators.reshape import pivot_mean

ITEM_TOTALS = ("items_sold", "revenue", "freight_value", "freight_items", "gmv", "priced_items")


def item_totals(items: DataFrame, *keys: str) -> DataFrame:
    """Item counts and sums per key. ``priced_items`` counts items with a full price."""
    return items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("items_sold"),
        F.sum("price").alias("revenue"),
        F.sum("freight_value").alias("freight_value"),
        F.count("freight_value").alias("freight_items"),
        F.sum(line_total()).alias("gmv"),
        F.count(line_total()).alias("priced_items"),
    )


def order_facts(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Every order row with its item totals, NULL without items."""
    return orders.select("order_id", "customer_id", "order_purchase_timestamp").join(
        item_totals(items, "order_id"), "order_id", "left"
    )


def sales_of_facts(facts: DataFrame) -> DataFrame:
    """``order_sales`` from ``order_facts``."""
    purchase = F.col("order_purchase_timestamp")
    return facts.where(purchase.isNotNull() & F.col("items_sold").isNotNull()).select(
        "order_id", "customer_id", to_day(purchase).alias("date"), *ITEM_TOTALS
    )


def order_sales(orders: DataFrame, items: DataFrame) -> DataFrame:
    """One row per dated order row that has items, with its item totals."""
    dated = orders.where(F.col("order_purchase_timestamp").isNotNull()).select(
        "order_id", "customer_id", to_day(F.col("order_purchase_timestamp")).alias("date")
    )
    return dated.join(item_totals(items, "order_id"), "order_id")


def _sums() -> list[Column]:
    return [
        F.sum("items_sold").alias("items_sold"),
        stable_sum(F.col("revenue")).alias("revenue"),
        stable_sum(F.col("freight_value")).alias("freight_value"),
        stable_sum(F.col("gmv")).alias("gmv"),
    ]


def _ticket() -> Column:
    return mean_from(F.col("gmv"), F.col("priced_items")).alias("average_ticket")


def sales_daily(sales: DataFrame) -> DataFrame:
    """Sales per purchase date from ``order_sales``; the ticket is a mean per item."""
    return sales.groupBy("date").agg(
        F.countDistinct("order_id").alias("orders"),
        F.countDistinct("customer_id").alias("customers"),
        *_sums(),
        _ticket(),
        mean_from(F.col("freight_value"), F.col("freight_items")).alias("average_freight"),
    )


def sales_monthly_totals(sales: DataFrame) -> DataFrame:
    return sales.groupBy(month_of(F.col("date")).alias("month")).agg(
        F.countDistinct("order_id").alias("orders"),
        F.countDistinct("customer_id").alias("customers"),
        *_sums(),
        _ticket(),
    )


def sales_monthly(sales: DataFrame) -> DataFrame:
    """Sales per purchase month with growth against the previous month row."""
    return series.growth(sales_monthly_totals(sales), "month", {"gmv_mom_growth": "gmv"})


def categorised_products(products: DataFrame, translation: DataFrame) -> DataFrame:
    """(product_id, category): translated name, else own name, else 'unknown'."""
    return (
        products.select("product_id", "product_category_name")
        .join(
            translation.select("product_category_name", "product_category_name_english"),
            "product_category_name", "left",
        )
        .select(
            "product_id",
            F.coalesce("product_category_name_english", "product_category_name",
                       F.lit(fixed.UNKNOWN_CATEGORY)).alias("category"),
        )
    )


def category_performance(items: DataFrame, products: DataFrame,
                         translation: DataFrame) -> DataFrame:
    """Sales per category.

    Products get their category first, so items meet one narrow list. Items stay on
    the left of a left join, where the runtime may split the partition of a
    bestseller, or broadcast the list when it proves small. Grouping then spreads a
    large category by its orders before the final merge.
    """
    sold = items.select("product_id", "order_id", "price", "freight_value")
    categorised = categorised_products(products, translation)
    return (
        sold.join(categorised, "product_id", "left")
        .groupBy(F.coalesce("category", F.lit(fixed.UNKNOWN_CATEGORY)).alias("category"))
        .agg(
            F.countDistinct("order_id").alias("orders"),
            F.count(F.lit(1)).alias("items_sold"),
            stable_sum(F.col("price")).alias("revenue"),
            stable_sum(F.col("freight_value")).alias("freight_value"),
            stable_sum(line_total()).alias("gmv"),
            stable_mean(line_total(), MONEY_DIGITS).alias("average_ticket"),
        )
    )


def customer_metrics(customers: DataFrame, orders: DataFrame, items: DataFrame) -> DataFrame:
    """Sales per customer; customers without orders stay with NULL metrics.

    Orders are totalled per customer before the join, so that a customer owning many
    orders joins as one row. Repeated customer rows multiply sums, as they would in
    the joined form.
    """
    return customer_metrics_of_facts(customers, order_facts(orders, items))


def customer_metrics_of_facts(customers: DataFrame, facts: DataFrame) -> DataFrame:
    """``customer_metrics`` from ``order_facts``."""
    per_customer = facts.where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.countDistinct("order_id").alias("orders"),
        F.sum("gmv").alias("gmv"),
        F.sum("priced_items").alias("priced_items"),
        F.min("order_purchase_timestamp").alias("first_order"),
        F.max("order_purchase_timestamp").alias("last_order"),
    )
    listed = customers.groupBy(
        "customer_id", "customer_unique_id", "customer_state", "customer_city"
    ).agg(F.count(F.lit(1)).alias("copies"))
    return listed.join(per_customer, "customer_id", "left").select(
        "customer_id",
        "customer_unique_id",
        "customer_state",
        "customer_city",
        F.coalesce("orders", F.lit(0)).alias("orders"),
        F.round(F.col("gmv") * F.col("copies"), MONEY_DIGITS).alias("gmv"),
        F.try_divide(F.round("gmv", MONEY_DIGITS), F.col("priced_items")).alias("average_ticket"),
        to_day(F.col("first_order")).alias("first_order_date"),
        to_day(F.col("last_order")).alias("last_order_date"),
    )


def seller_metrics(sellers: DataFrame, items: DataFrame) -> DataFrame:
    """Sales per seller. A seller without sales counts one item row and no order."""
    totals = items.where(F.col("seller_id").isNotNull()).groupBy("seller_id").agg(
        F.countDistinct("order_id").alias("orders"),
        F.count(F.lit(1)).alias("items_sold"),
        F.sum("price").alias("revenue"),
        F.sum("freight_value").alias("freight_value"),
        F.sum(line_total()).alias("gmv"),
        F.count(line_total()).alias("priced_items"),
    )
    listed = sellers.groupBy("seller_id", "seller_state", "seller_city").agg(
        F.count(F.lit(1)).alias("copies")
    )
    return listed.join(totals, "seller_id", "left").select(
        "seller_id",
        "seller_state",
        "seller_city",
        F.coalesce("orders", F.lit(0)).alias("orders"),
        (F.coalesce("items_sold", F.lit(1)) * F.col("copies")).alias("items_sold"),
        F.round(F.col("revenue") * F.col("copies"), MONEY_DIGITS).alias("revenue"),
        F.round(F.col("freight_value") * F.col("copies"), MONEY_DIGITS).alias("freight_value"),
        F.try_divide(F.round("gmv", MONEY_DIGITS), F.col("priced_items")).alias("average_ticket"),
    )


def delivery_metrics(orders: DataFrame) -> DataFrame:
    """Delivery time and delay per purchase date, over all orders, delivered or not."""
    purchase = F.col("order_purchase_timestamp")
    delivered = F.col("order_delivered_customer_date")
    estimated = F.col("order_estimated_delivery_date")
    late = sum_when(delivered > estimated)
    return (
        orders.where(purchase.isNotNull())
        .groupBy(to_day(purchase).alias("date"))
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.avg(day_distance(purchase, delivered)).alias("avg_delivery_days"),
            F.avg(day_distance(purchase, estimated)).alias("avg_estimated_days"),
            late.alias("delayed_orders"),
            F.try_divide(late, F.count(F.lit(1))).alias("delay_rate"),
        )
    )


def review_metrics(reviews: DataFrame) -> DataFrame:
    """Review counts and mean score per review date."""
    score, created = F.col("review_score"), F.col("review_creation_date")
    return (
        reviews.where(created.isNotNull())
        .groupBy(to_day(created).alias("date"))
        .agg(
            F.count(F.lit(1)).alias("reviews"),
            F.avg(score).alias("average_review_score"),
            sum_when(score >= fixed.POSITIVE_SCORE).alias("positive_reviews"),
            sum_when(score <= fixed.NEGATIVE_SCORE).alias("negative_reviews"),
        )
    )


def monthly_indicator_means(series_rows: DataFrame, statistics: DataFrame) -> DataFrame:
    """(reference_month, indicator_name, value): mean per month, both sources together."""
    daily = series_rows.select(
        month_of(F.col("date")).alias("reference_month"), "indicator_name", "value"
    )
    monthly = statistics.select(
        to_day(F.col("reference_month")).alias("reference_month"), "indicator_name", "value"
    )
    return daily.unionByName(monthly).groupBy("reference_month", "indicator_name").agg(
        stable_mean(F.col("value")).alias("value")
    )


def economic_indicators(series_rows: DataFrame, statistics: DataFrame) -> DataFrame:
    """One row per month, one column per indicator.

    Each (month, indicator) is a single mean already, so the pivot runs on as many
    rows as there are months times four.
    """
    return pivot_mean(
        monthly_indicator_means(series_rows, statistics),
        "reference_month", "indicator_name", "value", fixed.INDICATORS,
    )


def sales_economic_features(monthly: DataFrame, indicators: DataFrame) -> DataFrame:
    """Monthly sales beside the month's indicators, with changes against the row before."""
    joined = monthly.join(
        indicators, monthly["month"] == indicators["reference_month"], "left"
    )
    changed = series.first_differences(
        joined, "month", {f"{name}_change": name for name in fixed.INDICATORS}
    )
    return series.growth(
        changed, "month", {"sales_growth": "gmv", "ticket_growth": "average_ticket"}
    )


def ml_features(daily: DataFrame) -> DataFrame:
    """Daily sales with lagged, rolling and log features."""
    lagged = series.row_lags(
        daily, "date", "gmv", {"sales_lag_1": 1, "sales_lag_7": 7, "sales_lag_30": 30}
    )
    means = series.rolling_means(
        lagged, "date", "gmv", {"rolling_mean_7": 7, "rolling_mean_30": 30}
    )
    spreads = series.rolling_deviations(
        means, "date", "gmv", {"rolling_std_7": 7, "rolling_std_30": 30}
    )
    return spreads.withColumn("log_gmv", F.log1p("gmv"))


def anomaly_metrics(daily: DataFrame) -> DataFrame:
    """Daily metrics with a global z-score flag each."""
    metrics = daily.select("date", *fixed.ANOMALY_METRICS)
    return outliers.zscore_flags(metrics, fixed.ANOMALY_METRICS, fixed.ZSCORE_THRESHOLD)


def dim_date(bounds: DataFrame, first: str, last: str) -> DataFrame:
    """Calendar dimension over a one-row frame's inclusive date range."""
    return series.calendar_days(bounds, first, last).select(*calendar_columns(F.col("date")))


def dim_date_of_sales(daily: DataFrame) -> DataFrame:
    """Calendar from the first to the last sales day."""
    return dim_date(
        daily.agg(F.min("date").alias("first"), F.max("date").alias("last")), "first", "last"
    )


OUTPUT_ORDER = {
    "sales_daily": "date",
    "sales_monthly": "month",
    "category_performance": "gmv desc, category",
    "delivery_metrics": "date",
    "review_metrics": "date",
}


def in_output_order(dataset: str, df: DataFrame) -> DataFrame:
    """Sort a dataset as it is published. The plans above leave rows unsorted, since
    anything computed from them would only pay for the sort and lose it again."""
    keys = []
    for part in OUTPUT_ORDER.get(dataset, "").split(", "):
        name, _, direction = part.partition(" ")
        if name:
            keys.append(F.col(name).desc() if direction == "desc" else F.col(name))
    return df.orderBy(*keys) if keys else df
