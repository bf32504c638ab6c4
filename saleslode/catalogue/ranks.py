"""RFM scoring: distributed quantile and rank bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslode.catalogue.gold import _sales
from saleslode.catalogue.sqltext import oracle
from saleslode.operators.ranking import QUARTILES, exact_quantiles
from saleslode.plans import rfm
from saleslode.session import cut_lineage
from saleslode.sources.shipped import ShippedTables


def _base(spark: SparkSession, folder: str) -> DataFrame:
    return rfm.with_recency(cut_lineage(rfm.rfm_base(_sales(spark, folder))))


def _value_scores(spark: SparkSession, folder: str) -> DataFrame:
    base = _base(spark, folder)
    edges = rfm.value_edges(base, "recency_days", "monetary")
    return base.select(
        "customer_id",
        (F.lit(6) - rfm.value_score("recency_days", edges)).alias("recency_score"),
        rfm.value_score("monetary", edges).alias("monetary_score"),
    )


def _frequency_scores(spark: SparkSession, folder: str) -> DataFrame:
    base = _base(spark, folder)
    return base.select(
        "customer_id", "frequency",
        rfm.frequency_score(rfm.frequency_edges(base)).alias("frequency_score"),
    )


def _price_quartiles(spark: SparkSession, folder: str) -> DataFrame:
    items = ShippedTables(spark, folder).order_items()
    found = exact_quantiles(items, "price", QUARTILES, ("seller_id",))
    return found.select(
        "seller_id", "total", F.round(F.col("quantiles")[0], 6).alias("q1"),
        F.round(F.col("quantiles")[1], 6).alias("q3"),
    )


QUERIES = {
    "a11_rfm_base": _base,
    "w6_value_scores": _value_scores,
    "w6_grouped_quantiles": _price_quartiles,
    "w7_frequency_scores": _frequency_scores,
    "p7_customer_rfm": lambda s, d: rfm.customer_rfm(_sales(s, d)),
    "f11_score_text": lambda s, d: rfm.customer_rfm(_sales(s, d)).groupBy("rfm_score").count()
    .withColumnRenamed("count", "customers"),
}

ORACLES = {
    "a11_rfm_base": oracle("select * from g_rfm_base"),
    "w6_value_scores": oracle("select customer_id, recency_score, monetary_score from g_rfm"),
    "w6_grouped_quantiles": oracle(
        "select seller_id, count(*) as total, round(quantile_cont(price, 0.25), 6) as q1,"
        " round(quantile_cont(price, 0.75), 6) as q3 from lg_items group by 1"
    ),
    "w7_frequency_scores": oracle("select customer_id, frequency, frequency_score from g_rfm"),
    "p7_customer_rfm": oracle("select * from g_rfm"),
    "f11_score_text": oracle("select rfm_score, count(*) as customers from g_rfm group by 1"),
}
