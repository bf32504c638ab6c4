"""KPIs, economic correlations and review intelligence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleslode import settings as fixed
from saleslode.functions import after, has_text, sum_when, truthy

TOP_CATEGORIES = 10


def daily_kpis(daily: DataFrame) -> DataFrame:
    """Totals over the daily series. Customers sum the daily distinct counts; mean
    freight is the mean of the daily means."""
    return daily.agg(
        F.min("date").alias("period_start"),
        F.max("date").alias("period_end"),
        F.count(F.lit(1)).alias("sales_daily_rows"),
        F.round(F.sum("gmv"), 2).alias("gmv_total"),
        F.round(F.sum("revenue"), 2).alias("revenue_total"),
        F.sum("orders").alias("orders_total"),
        F.sum("customers").alias("customers_total"),
        F.sum("items_sold").alias("items_sold_total"),
        F.round(F.try_divide(F.sum("gmv"), F.sum("items_sold")), 2).alias(
            "average_ticket_per_item"
        ),
        F.round(F.avg("average_freight"), 2).alias("average_freight"),
    )


def top_categories(categories: DataFrame, limit: int = TOP_CATEGORIES) -> DataFrame:
    """One row holding the leading categories as an array of structs, best first."""
    leading = categories.orderBy(F.col("gmv").desc(), "category").limit(limit)
    ranked = F.sort_array(
        F.collect_list(F.struct((-F.col("gmv")).alias("order"), "category", "gmv", "orders"))
    )
    return leading.agg(
        F.transform(
            ranked,
            lambda c: F.struct(
                c["category"].alias("category"), c["gmv"].alias("gmv"),
                c["orders"].alias("orders"),
            ),
        ).alias("top_categories")
    )


def best_month(monthly: DataFrame) -> DataFrame:
    return monthly.agg(
        F.count(F.lit(1)).alias("sales_monthly_rows"),
        F.max_by("month", "gmv").alias("best_month_by_gmv"),
    )


def kpi_report(daily: DataFrame, monthly: DataFrame, categories: DataFrame, delivery: DataFrame,
               reviews: DataFrame, sellers: DataFrame) -> DataFrame:
    """All KPIs as one row. Each part is a one-row aggregate read as a scalar."""
    scalars = {
        "monthly": best_month(monthly),
        "top_categories": top_categories(categories),
        "active_sellers": sellers.agg(sum_when(F.col("orders") > 0)),
        "delivery": delivery.agg(
            F.round(F.avg("avg_delivery_days"), 2).alias("average_delivery_days"),
            F.round(F.avg("delay_rate"), 4).alias("average_delay_rate"),
        ),
        "average_review_score": reviews.agg(F.round(F.avg("average_review_score"), 2)),
    }

    def packed(name: str) -> Column:
        part = scalars[name]
        return part.select(F.struct(*part.columns).alias("v")).scalar()

    return daily_kpis(daily).select(
        "*",
        packed("monthly")["sales_monthly_rows"].alias("sales_monthly_rows"),
        packed("monthly")["best_month_by_gmv"].alias("best_month_by_gmv"),
        scalars["active_sellers"].scalar().alias("active_sellers"),
        packed("delivery")["average_delivery_days"].alias("average_delivery_days"),
        packed("delivery")["average_delay_rate"].alias("average_delay_rate"),
        scalars["average_review_score"].scalar().alias("average_review_score"),
        scalars["top_categories"].scalar().alias("top_categories"),
    )


def economic_correlations(features: DataFrame) -> DataFrame:
    """Correlation and sample covariance per (metric, indicator) over complete pairs.

    Fewer than three pairs give NULL, and so does a constant series.
    """
    metrics = [m for m in fixed.CORRELATION_METRICS if m in features.columns]
    indicators = [i for i in fixed.INDICATORS if i in features.columns]
    pairs = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"), F.lit(i).alias("indicator"),
                F.col(m).cast("double").alias("x"), F.col(i).cast("double").alias("y"),
            )
            for m in metrics
            for i in indicators
        ]
    )
    long = features.select(F.explode(pairs).alias("p")).select("p.*")
    complete = F.col("x").isNotNull() & F.col("y").isNotNull()
    x, y = F.when(complete, F.col("x")), F.when(complete, F.col("y"))
    enough = F.count(x) >= fixed.MIN_OBSERVATIONS
    return long.groupBy("metric", "indicator").agg(
        F.count(x).alias("observations"),
        F.when(
            enough,
            F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)),
        ).alias("correlation"),
        F.when(enough, F.covar_samp(x, y)).alias("covariance"),
    )


def flagged_reviews(reviews: DataFrame, orders: DataFrame) -> DataFrame:
    """Reviews with text, negativity and delay flags from their order."""
    dates = orders.select(
        "order_id", "order_delivered_customer_date", "order_estimated_delivery_date"
    )
    return reviews.join(dates, "order_id", "left").withColumns(
        {
            "has_review_text": has_text(F.col("review_comment_message")),
            "is_negative_review": F.col("review_score") <= fixed.NEGATIVE_SCORE,
            "was_delayed": after(
                F.col("order_delivered_customer_date"), F.col("order_estimated_delivery_date")
            ),
        }
    )


def review_counts(reviews: DataFrame, orders: DataFrame) -> DataFrame:
    """Review counts per (score, was_delayed), ready to be rolled up.

    The texts are reduced to a flag and the reviews counted per order before the join,
    so neither long texts nor the reviews of a single hot order are shuffled.
    """
    per_order = reviews.groupBy("order_id", "review_score").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("review_id").alias("reviews"),
        sum_when(has_text(F.col("review_comment_message"))).alias("text_reviews"),
    )
    dates = orders.select(
        "order_id",
        after(
            F.col("order_delivered_customer_date"), F.col("order_estimated_delivery_date")
        ).alias("was_delayed"),
    )
    return per_order.join(dates, "order_id", "left").groupBy(
        "review_score", truthy(F.col("was_delayed")).alias("was_delayed")
    ).agg(
        F.sum("rows").alias("rows"),
        F.sum("reviews").alias("reviews"),
        F.sum("text_reviews").alias("text_reviews"),
    )


def review_summary(counts: DataFrame) -> DataFrame:
    """Published summary; the unscored reviews stay as a group of their own."""
    return counts.select("review_score", "was_delayed", "reviews", "text_reviews")


def review_report(counts: DataFrame) -> DataFrame:
    """One row of ratios over all reviews and the resulting recommendation.

    Unscored reviews are left out of the mean score and of the negative ratio.
    """
    rows, score = F.sum("rows"), F.col("review_score")
    scored = F.sum(F.when(score.isNotNull(), F.col("rows")))
    negative = F.sum(F.when(score <= fixed.NEGATIVE_SCORE, F.col("rows")).otherwise(F.lit(0)))
    coverage = F.try_divide(F.sum("text_reviews"), rows)
    return counts.agg(
        rows.alias("rows"),
        coverage.alias("text_coverage_ratio"),
        F.try_divide(F.sum(score * F.col("rows")), scored).alias("average_review_score"),
        F.try_divide(negative, scored).alias("negative_review_ratio"),
        F.when(coverage >= fixed.TEXT_COVERAGE_FLOOR, F.lit(fixed.TEXT_SUFFICIENT))
        .otherwise(F.lit(fixed.TEXT_INSUFFICIENT))
        .alias("nlp_recommendation"),
    )
