"""Gold datasets, their joins, aggregations and series operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslode import settings as fixed
from saleslode.catalogue.sqltext import oracle
from saleslode.functions import day_distance, line_total, stable_sum
from saleslode.operators import ranges, series
from saleslode.operators.reshape import pivot_mean
from saleslode.plans import build, gold, rfm
from saleslode.session import cut_lineage
from saleslode.sources.shipped import ShippedTables


def _sales(spark: SparkSession, folder: str) -> DataFrame:
    t = ShippedTables(spark, folder)
    return gold.order_sales(t.orders(), t.order_items())


def _daily(spark: SparkSession, folder: str) -> DataFrame:
    return gold.sales_daily(_sales(spark, folder))


def _monthly(spark: SparkSession, folder: str) -> DataFrame:
    return gold.sales_monthly(_sales(spark, folder))


def _category(spark: SparkSession, folder: str) -> DataFrame:
    t = ShippedTables(spark, folder)
    return gold.category_performance(t.order_items(), t.products(), t.translation())


def _customers(spark: SparkSession, folder: str) -> DataFrame:
    t = ShippedTables(spark, folder)
    return gold.customer_metrics(t.customers(), t.orders(), t.order_items())


def _sellers(spark: SparkSession, folder: str) -> DataFrame:
    t = ShippedTables(spark, folder)
    return gold.seller_metrics(t.sellers(), t.order_items())


def _delivery(spark: SparkSession, folder: str) -> DataFrame:
    return gold.delivery_metrics(ShippedTables(spark, folder).delivered_orders())


def _reviews(spark: SparkSession, folder: str) -> DataFrame:
    return gold.review_metrics(ShippedTables(spark, folder).order_reviews())


def _indicators(spark: SparkSession, folder: str) -> DataFrame:
    t = ShippedTables(spark, folder)
    return gold.economic_indicators(t.series(), t.statistics())


def _features(spark: SparkSession, folder: str) -> DataFrame:
    return gold.sales_economic_features(_monthly(spark, folder), _indicators(spark, folder))


def _dim_date(spark: SparkSession, folder: str) -> DataFrame:
    return gold.dim_date_of_sales(_daily(spark, folder))


def shared_gold(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The datasets read by the suites and the warehouse.

    The orders-with-items fact and the small aggregates read more than once are
    stored, as a layer build does.
    """
    t = ShippedTables(spark, folder)
    sales = cut_lineage(gold.order_sales(t.orders(), t.order_items()))
    daily = cut_lineage(gold.sales_daily(sales))
    return {
        "sales_daily": daily,
        "sales_monthly": cut_lineage(gold.sales_monthly(sales)),
        "category_performance": cut_lineage(
            gold.category_performance(t.order_items(), t.products(), t.translation())
        ),
        "customer_metrics": gold.customer_metrics(t.customers(), t.orders(), t.order_items()),
        "seller_metrics": gold.seller_metrics(t.sellers(), t.order_items()),
        "economic_indicators": gold.economic_indicators(t.series(), t.statistics()),
        "customer_rfm": rfm.rfm_base(sales),
        "dim_date": gold.dim_date_of_sales(daily),
    }


def whole_gold(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All 13 datasets, as a layer build makes them."""
    t = ShippedTables(spark, folder)
    sources = {
        "orders": cut_lineage(t.delivered_orders()), "order_items": t.order_items(),
        "order_reviews": t.order_reviews(), "customers": t.customers(), "sellers": t.sellers(),
        "products": t.products(), "product_category_name_translation": t.translation(),
    }
    return build.gold_frames(sources, t.series(), t.statistics())


# -- parts of the datasets as queries of their own ----------------------------------
def _dated_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = ShippedTables(spark, folder).orders()
    return orders.where(F.col("order_purchase_timestamp").isNotNull()).select(
        "order_id", "customer_id", "order_purchase_timestamp"
    )


def _item_lines(spark: SparkSession, folder: str) -> DataFrame:
    items = ShippedTables(spark, folder).order_items()
    return items.select(
        "order_id", "order_item_id", "price",
        F.round("freight_value", 4).alias("freight_value"),
        F.round(line_total(), 4).alias("item_total"),
    )


def _order_sales(spark: SparkSession, folder: str) -> DataFrame:
    return _sales(spark, folder).select(
        "order_id", "customer_id", "date", "items_sold",
        *[F.round(c, 4).alias(c) for c in ("revenue", "freight_value", "gmv")],
    )


def _item_products(spark: SparkSession, folder: str) -> DataFrame:
    t = ShippedTables(spark, folder)
    joined = t.order_items().join(t.products(), "product_id", "left")
    return joined.groupBy("product_category_name").agg(
        F.count(F.lit(1)).alias("items_sold"), stable_sum(F.col("price")).alias("revenue")
    )


def _translated_products(spark: SparkSession, folder: str) -> DataFrame:
    t = ShippedTables(spark, folder)
    return gold.categorised_products(t.products(), t.translation())


def _snapshot(spark: SparkSession, folder: str) -> DataFrame:
    orders = ShippedTables(spark, folder).orders()
    day = F.col("order_purchase_timestamp").cast("date")
    newest = orders.agg(F.max(day)).scalar()
    return orders.select(
        "order_id", day.alias("order_date"), newest.alias("snapshot_date"),
        day_distance(day, newest).alias("age_days"),
    )


def _months_with_indicators(spark: SparkSession, folder: str) -> DataFrame:
    monthly, indicators = _monthly(spark, folder), _indicators(spark, folder)
    return monthly.select("month", "gmv").join(
        indicators, monthly["month"] == indicators["reference_month"], "left"
    )


def _delayed_flags(spark: SparkSession, folder: str) -> DataFrame:
    delivery = _delivery(spark, folder)
    return delivery.select("date", "orders", "delayed_orders")


def _delay_rate_sql(spark: SparkSession, folder: str) -> DataFrame:
    """Same measure through SQL, reusing an alias inside one SELECT."""
    ShippedTables(spark, folder).delivered_orders().createOrReplaceTempView("olist_orders")
    return spark.sql(
        """
        select cast(order_purchase_timestamp as date) as date,
               sum(case when order_delivered_customer_date > order_estimated_delivery_date
                        then 1 else 0 end) as delayed_orders,
               delayed_orders / nullif(count(*), 0) as delay_rate
        from olist_orders where order_purchase_timestamp is not null group by 1
        """
    )


def _monthly_sql(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly orders from registered views."""
    t = ShippedTables(spark, folder)
    t.orders().createOrReplaceTempView("olist_orders")
    t.order_items().createOrReplaceTempView("olist_order_items")
    return spark.sql(
        """
        select cast(date_trunc('month', o.order_purchase_timestamp) as date) as month,
               count(distinct o.order_id) as orders, count(*) as items_sold
        from olist_orders o join olist_order_items i using (order_id)
        where o.order_purchase_timestamp is not null group by 1
        """
    )


def _union_series(spark: SparkSession, folder: str) -> DataFrame:
    t = ShippedTables(spark, folder)
    rows = t.one_series("selic_target")
    for name in ("usd_brl", "ibc_br"):
        rows = rows.unionByName(t.one_series(name))
    return rows.groupBy("indicator_name").agg(
        F.count(F.lit(1)).alias("observations"), stable_sum(F.col("value"), 6).alias("value_sum")
    )


def _indicator_means(spark: SparkSession, folder: str) -> DataFrame:
    t = ShippedTables(spark, folder)
    return gold.monthly_indicator_means(t.series(), t.statistics())


def _both_sources(spark: SparkSession, folder: str) -> DataFrame:
    return _indicator_means(spark, folder).groupBy("indicator_name").agg(
        F.count(F.lit(1)).alias("months"),
        F.min("reference_month").alias("first_month"),
        F.max("reference_month").alias("last_month"),
    )


def _events_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """The same pivot on a day-grain event table."""
    events = ShippedTables(spark, folder).raw("events")
    names = ("click", "error", "purchase", "signup", "view")
    daily = events.groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(
        F.try_divide(stable_sum(F.col("value")), F.count("value")).alias("value")
    )
    return pivot_mean(daily, "day", "event_type", "value", names)


def _lags(spark: SparkSession, folder: str) -> DataFrame:
    return series.row_lags(
        _daily(spark, folder).select("date", "gmv"), "date", "gmv",
        {"sales_lag_1": 1, "sales_lag_7": 7, "sales_lag_30": 30},
    )


def _rolling_means(spark: SparkSession, folder: str) -> DataFrame:
    return series.rolling_means(
        _daily(spark, folder).select("date", "gmv"), "date", "gmv",
        {"rolling_mean_7": 7, "rolling_mean_30": 30},
    )


def _rolling_deviations(spark: SparkSession, folder: str) -> DataFrame:
    rolled = series.rolling_deviations(
        _daily(spark, folder).select("date", "gmv"), "date", "gmv",
        {"rolling_std_7": 7, "rolling_std_30": 30},
    )
    return _rounded(rolled, "rolling_std_7", "rolling_std_30")


def _growth(spark: SparkSession, folder: str) -> DataFrame:
    monthly = gold.sales_monthly_totals(_sales(spark, folder))
    grown = series.growth(
        monthly.select("month", "gmv", "average_ticket"), "month",
        {"sales_growth": "gmv", "ticket_growth": "average_ticket"},
    )
    return _rounded(grown, "sales_growth", "ticket_growth", digits=8)


def _differences(spark: SparkSession, folder: str) -> DataFrame:
    changed = series.first_differences(
        _indicators(spark, folder), "reference_month",
        {f"{name}_change": name for name in fixed.INDICATORS},
    )
    return changed.select(
        "reference_month", *[F.round(f"{n}_change", 8).alias(f"{n}_change")
                             for n in fixed.INDICATORS]
    )


def _event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """All series operators over single events, in ranges of consecutive rows."""
    events = ShippedTables(spark, folder).raw("events").select(
        "event_id", "ts", "value", F.when(F.col("event_type") != "error", F.col("value"))
        .alias("seen"))
    numbered = ranges.numbered_series(events, [F.col("ts"), F.col("event_id")])

    def windows(rows: DataFrame, order: str, within: Sequence[str]) -> DataFrame:
        rows = series.row_lags(rows, order, "value", {"lag_1": 1, "lag_30": 30}, within)
        rows = series.rolling_means(rows, order, "value", {"mean_30": 30}, within)
        rows = series.rolling_deviations(rows, order, "value", {"std_30": 30}, within)
        return series.first_differences(rows, order, {"change": "value"}, within)

    rows = ranges.range_growth(numbered, {"growth": "seen"})
    rows = ranges.over_ranges(rows, 30, windows)
    split = ranges.range_split(rows, 0.8).drop("row_number", "ts")
    return _rounded(split, "std_30", "change", "growth", digits=4)


def _rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({name: F.round(name, digits) for name in names})


def _features_rounded(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(
        _features(spark, folder), "gmv_mom_growth", "sales_growth", "ticket_growth",
        *[f"{name}_change" for name in fixed.INDICATORS], digits=8,
    )


def _ml_features_rounded(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(
        gold.ml_features(_daily(spark, folder)),
        "rolling_std_7", "rolling_std_30", "log_gmv",
    )


def _monthly_rounded(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_monthly(spark, folder), "gmv_mom_growth", digits=8)


QUERIES = {
    "s9_sql_views": _monthly_sql,
    "p1_dated_orders": _dated_orders,
    "p5_item_totals": _item_lines,
    "p6_delayed_flags": _delayed_flags,
    "p8_product_categories": _translated_products,
    "p15_delay_rate": _delay_rate_sql,
    "j1_order_sales": _order_sales,
    "j2_item_products": _item_products,
    "j6_snapshot_date": _snapshot,
    "j7_months_with_indicators": _months_with_indicators,
    "a1_sales_daily": _daily,
    "a2_sales_monthly": _monthly_rounded,
    "a3_category_performance": _category,
    "a4_customer_metrics": _customers,
    "a5_seller_metrics": _sellers,
    "a6_delivery_metrics": _delivery,
    "a7_review_metrics": _reviews,
    "a8_monthly_indicator_means": _indicator_means,
    "a9_economic_indicators": _indicators,
    "a10_order_totals": lambda s, d: rfm.order_totals(_sales(s, d)),
    "u1_series_union": _union_series,
    "u2_both_sources": _both_sources,
    "u3_daily_event_pivot": _events_pivot,
    "u7_dim_date": _dim_date,
    "w1_row_lags": _lags,
    "w2_rolling_means": _rolling_means,
    "w3_rolling_deviations": _rolling_deviations,
    "w4_growth": _growth,
    "w5_first_differences": _differences,
    "w1_w11_event_windows": _event_windows,
    "w8_anomaly_metrics": lambda s, d: gold.anomaly_metrics(_daily(s, d)),
    "t7_sales_economic_features": _features_rounded,
    "t7_ml_features": _ml_features_rounded,
}

_CHANGES = ", ".join(f"round({n}_change, 8) as {n}_change" for n in fixed.INDICATORS)

ORACLES = {
    "s9_sql_views": oracle("select month, orders, items_sold from g_monthly_totals"),
    "p1_dated_orders": oracle(
        "select order_id, customer_id, order_purchase_timestamp from lg_orders"
        " where order_purchase_timestamp is not null"
    ),
    "p5_item_totals": oracle(
        "select order_id, order_item_id, price, round(freight_value, 4) as freight_value,"
        " round(price + freight_value, 4) as item_total from lg_items"
    ),
    "p6_delayed_flags": oracle("select date, orders, delayed_orders from g_delivery"),
    "p8_product_categories": oracle(
        "select p.product_id, coalesce(t.product_category_name_english,"
        " p.product_category_name, 'unknown') as category from lg_products p"
        " left join lg_translation t using (product_category_name)"
    ),
    "p15_delay_rate": oracle("select date, delayed_orders, delay_rate from g_delivery"),
    "j1_order_sales": oracle(
        "select order_id, customer_id, date, count(*) as items_sold,"
        " round(sum(price), 4) as revenue, round(sum(freight_value), 4) as freight_value,"
        " round(sum(price + freight_value), 4) as gmv from g_joined group by 1, 2, 3"
    ),
    "j2_item_products": oracle(
        "select p.product_category_name, count(*) as items_sold,"
        " round(sum(i.price), 4) as revenue from lg_items i"
        " left join lg_products p on p.product_id = i.product_id group by 1"
    ),
    "j6_snapshot_date": oracle(
        "select order_id, cast(order_purchase_timestamp as date) as order_date, snapshot_date,"
        " cast(date_diff('day', cast(order_purchase_timestamp as date), snapshot_date) as int)"
        " as age_days from lg_orders cross join (select max(cast(order_purchase_timestamp"
        " as date)) as snapshot_date from lg_orders) s"
    ),
    "j7_months_with_indicators": oracle(
        "select s.month, s.gmv, e.* from g_monthly_totals s"
        " left join g_indicators e on e.reference_month = s.month"
    ),
    "a1_sales_daily": oracle("select * from g_sales_daily"),
    "a2_sales_monthly": oracle(
        "select * replace (round(gmv_mom_growth, 8) as gmv_mom_growth) from g_sales_monthly"
    ),
    "a3_category_performance": oracle("select * from g_category"),
    "a4_customer_metrics": oracle("select * from g_customers"),
    "a5_seller_metrics": oracle("select * from g_sellers"),
    "a6_delivery_metrics": oracle("select * from g_delivery"),
    "a7_review_metrics": oracle("select * from g_reviews"),
    "a8_monthly_indicator_means": oracle("select * from g_indicator_means"),
    "a9_economic_indicators": oracle("select * from g_indicators"),
    "a10_order_totals": oracle("select * from g_order_totals"),
    "u1_series_union": oracle(
        "select indicator_name, count(*) as observations, round(sum(value), 6) as value_sum"
        " from (select * from lg_series where indicator_name = 'selic_target' union all"
        " select * from lg_series where indicator_name = 'usd_brl' union all"
        " select * from lg_series where indicator_name = 'ibc_br') u group by 1"
    ),
    "u2_both_sources": oracle(
        "select indicator_name, count(*) as months, min(reference_month) as first_month,"
        " max(reference_month) as last_month from g_indicator_means group by 1"
    ),
    "u3_daily_event_pivot": (
        "select cast(ts as date) as day, "
        + ", ".join(
            f"round(sum(value) filter (where event_type = '{e}'), 4)"
            f" / nullif(count(value) filter (where event_type = '{e}'), 0) as {e}"
            for e in ("click", "error", "purchase", "signup", "view")
        )
        + " from events where ts is not null group by 1 having count(value) > 0"
    ),
    "u7_dim_date": oracle("select * from g_dim_date"),
    "w1_row_lags": oracle(
        "select date, gmv, sales_lag_1, sales_lag_7, sales_lag_30 from g_ml_features"
    ),
    "w1_w11_event_windows": """
        with numbered as (
            select event_id, value, row_number() over w - 1 as row_index,
                   case when event_type <> 'error' then value end as seen
            from events window w as (order by ts, event_id)
        ), filled as (
            select *, last_value(seen ignore nulls) over (
                order by row_index rows between unbounded preceding and current row) as held
            from numbered
        )
        select event_id, value, seen, row_index,
               lag(value, 1) over o as lag_1, lag(value, 30) over o as lag_30,
               round(sum(value) over p, 4) / count(value) over p as mean_30,
               round(stddev_samp(value) over p, 4) as std_30,
               round(value - lag(value) over o, 4) as change,
               round(held / nullif(lag(held) over o, 0) - 1, 4) as growth,
               row_index < floor(count(*) over () * 0.8) as is_train
        from filled
        window o as (order by row_index),
               p as (order by row_index rows between 29 preceding and current row)
    """,
    "w2_rolling_means": oracle(
        "select date, gmv, rolling_mean_7, rolling_mean_30 from g_ml_features"
    ),
    "w3_rolling_deviations": oracle(
        "select date, gmv, round(rolling_std_7, 4) as rolling_std_7,"
        " round(rolling_std_30, 4) as rolling_std_30 from g_ml_features"
    ),
    "w4_growth": oracle(
        "select month, gmv, average_ticket, round(sales_growth, 8) as sales_growth,"
        " round(ticket_growth, 8) as ticket_growth from g_features"
    ),
    "w5_first_differences": oracle(
        "select reference_month, "
        + ", ".join(
            f"round({n} - lag({n}) over (order by reference_month), 8) as {n}_change"
            for n in fixed.INDICATORS
        )
        + " from g_indicators"
    ),
    "w8_anomaly_metrics": oracle("select * from g_anomalies"),
    "t7_sales_economic_features": oracle(
        "select * replace (round(gmv_mom_growth, 8) as gmv_mom_growth,"
        " round(sales_growth, 8) as sales_growth, round(ticket_growth, 8) as ticket_growth, "
        + _CHANGES + ") from g_features"
    ),
    "t7_ml_features": oracle(
        "select * replace (round(rolling_std_7, 4) as rolling_std_7,"
        " round(rolling_std_30, 4) as rolling_std_30, round(log_gmv, 4) as log_gmv)"
        " from g_ml_features"
    ),
}
