"""KPIs, correlations and review intelligence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslode import settings as fixed
from saleslode.catalogue.gold import (
    _category,
    _daily,
    _delivery,
    _features,
    _monthly,
    _reviews,
    _sellers,
)
from saleslode.catalogue.sqltext import oracle
from saleslode.plans import analytics, serving
from saleslode.sources.shipped import ShippedTables


def _kpi_report(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.kpi_report(
        _daily(spark, folder), _monthly(spark, folder), _category(spark, folder),
        _delivery(spark, folder), _reviews(spark, folder), _sellers(spark, folder),
    )


def _leading(spark: SparkSession, folder: str) -> DataFrame:
    report = analytics.top_categories(_category(spark, folder))
    return report.select(F.posexplode("top_categories").alias("place", "c")).select(
        (F.col("place") + 1).alias("place"), "c.category", "c.gmv", "c.orders"
    )


def _correlations(spark: SparkSession, folder: str) -> DataFrame:
    found = analytics.economic_correlations(_features(spark, folder))
    return found.withColumns(
        {"correlation": F.round("correlation", 6), "covariance": F.round("covariance", 4)}
    )


def _strongest(spark: SparkSession, folder: str) -> DataFrame:
    found = analytics.economic_correlations(_features(spark, folder))
    return serving.strongest_correlation(found).select(
        "metric", "indicator", "observations", F.round("correlation", 6).alias("correlation")
    )


def _review_counts(spark: SparkSession, folder: str) -> DataFrame:
    t = ShippedTables(spark, folder)
    return analytics.review_counts(t.order_reviews(), t.delivered_orders())


def _flagged(spark: SparkSession, folder: str) -> DataFrame:
    t = ShippedTables(spark, folder)
    return analytics.flagged_reviews(t.order_reviews(), t.delivered_orders()).select(
        "review_id", "has_review_text", "is_negative_review", "was_delayed"
    )


QUERIES = {
    "a12_daily_kpis": lambda s, d: analytics.daily_kpis(_daily(s, d)),
    "m10_kpi_report": lambda s, d: _kpi_report(s, d).drop("top_categories"),
    "m11_kpi_projection": lambda s, d: serving.kpi_projection(_kpi_report(s, d)),
    "o4_leading_categories": _leading,
    "o5_best_month": lambda s, d: analytics.best_month(_monthly(s, d)),
    "a13_correlations": _correlations,
    "m9_economic_analysis": lambda s, d: _correlations(s, d).withColumn(
        "notes", F.lit(" ".join(fixed.ECONOMIC_NOTES))
    ),
    "o8_strongest_correlation": _strongest,
    "j8_reviews_with_orders": _flagged,
    "a14_review_summary": lambda s, d: analytics.review_summary(_review_counts(s, d)),
    "a15_review_report": lambda s, d: analytics.review_report(_review_counts(s, d)),
    "m8_review_intelligence": lambda s, d: analytics.review_report(
        _review_counts(s, d)
    ).select("rows", "nlp_recommendation"),
}

_DAILY_KPIS = """
    select min(date) as period_start, max(date) as period_end, count(*) as sales_daily_rows,
           round(sum(gmv), 2) as gmv_total, round(sum(revenue), 2) as revenue_total,
           cast(sum(orders) as bigint) as orders_total,
           cast(sum(customers) as bigint) as customers_total,
           cast(sum(items_sold) as bigint) as items_sold_total,
           round(sum(gmv) / sum(items_sold), 2) as average_ticket_per_item,
           round(avg(average_freight), 2) as average_freight
    from g_sales_daily"""
_REPORT = """
    select k.*, (select count(*) from g_sales_monthly) as sales_monthly_rows,
           (select max_by(month, gmv) from g_sales_monthly) as best_month_by_gmv,
           (select cast(sum(case when orders > 0 then 1 else 0 end) as bigint) from g_sellers)
               as active_sellers,
           (select round(avg(avg_delivery_days), 2) from g_delivery) as average_delivery_days,
           (select round(avg(delay_rate), 4) from g_delivery) as average_delay_rate,
           (select round(avg(average_review_score), 2) from g_reviews) as average_review_score
    from k"""
_PAIRS = " union all ".join(
    f"select '{m}' as metric, '{i}' as indicator, count(*) as observations,"
    f" case when count(*) >= 3 then corr({m}, {i}) end as correlation,"
    f" case when count(*) >= 3 then covar_samp({m}, {i}) end as covariance"
    f" from g_features where {m} is not null and {i} is not null"
    for m in fixed.CORRELATION_METRICS
    for i in fixed.INDICATORS
)
_FLAGGED = """
    select r.review_id, r.review_score,
           regexp_matches(coalesce(r.review_comment_message, ''), '\\S') as has_review_text,
           r.review_score <= 2 as is_negative_review,
           coalesce(o.order_delivered_customer_date > o.order_estimated_delivery_date, false)
               as was_delayed
    from lg_reviews r left join lg_delivered o on o.order_id = r.order_id"""
_ROUNDED_PAIRS = ("select metric, indicator, observations, round(correlation, 6) as correlation,"
                  " round(covariance, 4) as covariance")

ORACLES = {
    "a12_daily_kpis": oracle(_DAILY_KPIS),
    "m10_kpi_report": oracle(_REPORT, k=_DAILY_KPIS),
    "m11_kpi_projection": oracle("""
        select period_start, period_end, gmv_total, revenue_total, orders_total, customers_total,
               items_sold_total, average_ticket_per_item as average_ticket, average_freight,
               active_sellers, average_delivery_days, average_delay_rate, average_review_score,
               best_month_by_gmv,
               (select category from g_category order by gmv desc, category limit 1)
                   as top_category_by_gmv
        from r""", k=_DAILY_KPIS, r=_REPORT),
    "o4_leading_categories": oracle("""
        select cast(row_number() over (order by gmv desc, category) as int) as place, category,
               gmv, orders from g_category order by place limit 10"""),
    "o5_best_month": oracle(
        "select count(*) as sales_monthly_rows, max_by(month, gmv) as best_month_by_gmv"
        " from g_sales_monthly"
    ),
    "a13_correlations": oracle(f"{_ROUNDED_PAIRS} from ({_PAIRS}) p"),
    "m9_economic_analysis": oracle(
        f"{_ROUNDED_PAIRS}, '{' '.join(fixed.ECONOMIC_NOTES)}' as notes from ({_PAIRS}) p"
    ),
    "o8_strongest_correlation": oracle(
        "select metric, indicator, observations, round(correlation, 6) as correlation"
        f" from ({_PAIRS}) p order by abs(correlation) desc nulls last limit 1"
    ),
    "j8_reviews_with_orders": oracle(
        "select review_id, has_review_text, is_negative_review, was_delayed from f", f=_FLAGGED
    ),
    "a14_review_summary": oracle("""
        select review_score, was_delayed, count(review_id) as reviews,
               cast(sum(cast(has_review_text as int)) as bigint) as text_reviews
        from f group by 1, 2""", f=_FLAGGED),
    "a15_review_report": oracle("""
        select count(*) as rows, avg(cast(has_review_text as int)) as text_coverage_ratio,
               avg(review_score) as average_review_score,
               avg(cast(is_negative_review as int)) as negative_review_ratio,
               case when avg(cast(has_review_text as int)) >= 0.2
                    then 'text_quality_sufficient_for_future_nlp'
                    else 'prioritize_score_delivery_analysis_before_nlp' end
                   as nlp_recommendation
        from f""", f=_FLAGGED),
    "m8_review_intelligence": oracle("""
        select count(*) as rows,
               case when avg(cast(has_review_text as int)) >= 0.2
                    then 'text_quality_sufficient_for_future_nlp'
                    else 'prioritize_score_delivery_analysis_before_nlp' end
                   as nlp_recommendation
        from f""", f=_FLAGGED),
}
