"""Recency, frequency and monetary scores per customer.

Customers are as many as the data has, so no score may sort them in one task. Value
bins need four edges and rank bins need four boundary keys; both come from the
narrowing counts in ``operators.ranking`` and are then compared row by row.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleslode import settings as fixed
from saleslode.functions import day_distance, stable_sum
from saleslode.operators.ranking import (
    QUINTILES,
    bin_by_edges,
    exact_quantiles,
    rank_bin_edges,
)
from saleslode.session import cut_lineage

# Hash digits that split one frequency's customers into at most 16^4 counted cells, and
# each of those into as many.
TIE_DIGITS = (4, 8)


def order_totals(sales: DataFrame) -> DataFrame:
    """Total per (customer, order, purchase date)."""
    return sales.groupBy("customer_id", "order_id", F.col("date").alias("order_date")).agg(
        stable_sum(F.col("gmv")).alias("order_total")
    )


def rfm_base(sales: DataFrame) -> DataFrame:
    """(customer_id, last_order_date, frequency, monetary) from ``order_sales``."""
    return sales.groupBy("customer_id").agg(
        F.max("date").alias("last_order_date"),
        F.countDistinct("order_id").alias("frequency"),
        stable_sum(F.col("gmv")).alias("monetary"),
    )


def with_recency(base: DataFrame) -> DataFrame:
    """Days between each customer's last order and the last order of all."""
    snapshot = base.agg(F.max("last_order_date")).scalar()
    return base.select(
        "customer_id",
        day_distance(F.col("last_order_date"), snapshot).cast("bigint").alias("recency_days"),
        "frequency",
        "monetary",
    )


def value_edges(df: DataFrame, *columns: str) -> dict[str, list[float]]:
    """Quintile edges of each column: four numbers per column come to the driver."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "name", "_v"
    )
    rows = exact_quantiles(
        long, "_v", QUINTILES, ("name",), out="edges", few_groups=True
    ).collect()
    return {row["name"]: list(row["edges"]) for row in rows}


def _tie_key() -> list[Column]:
    """Order of customers within one frequency: by hashed id."""
    hashed = F.md5(F.col("customer_id").cast("string"))
    prefixes = [F.substring(hashed, 1, n).alias(f"prefix_{n}") for n in TIE_DIGITS]
    return [F.col("frequency"), *prefixes, hashed.alias("tie")]


TIE_LEVELS = ("frequency", *(f"prefix_{n}" for n in TIE_DIGITS), "tie")


def frequency_edges(df: DataFrame) -> list[tuple]:
    """Keys closing each fifth of the customers ranked by frequency: four keys.

    Counting narrows by frequency, then by the leading hash digits, then by the hash.
    There are at most sqrt(2 * orders) distinct frequencies, so every counted level
    stays small even where nearly all customers share one frequency.
    """
    edges = rank_bin_edges(
        df.select(*_tie_key()), TIE_LEVELS, fixed.RFM_BINS
    ).collect()
    return [tuple(key) for row in edges for key in row["edges"]]


def value_score(column: str, edges: dict[str, list[float]]) -> Column:
    """1..5 by value quintile, intervals closed on the right."""
    return bin_by_edges(F.col(column), [F.lit(edge) for edge in edges.get(column, [])])


def frequency_score(edges: list[tuple]) -> Column:
    """1..5 by equal-frequency bins of a first-come rank."""
    keys = [F.struct(*[F.lit(part).alias(name) for name, part in zip(TIE_LEVELS, key, strict=True)])
            for key in edges]
    return bin_by_edges(F.struct(*_tie_key()), keys)


def score_text(*scores: str) -> Column:
    """Scores side by side; an unknown score prints as <NA>."""
    return F.concat(*[F.coalesce(F.col(s).cast("string"), F.lit("<NA>")) for s in scores])


def rfm_segment() -> Column:
    """First matching segment; comparisons with an unknown score do not match."""
    recency, frequency, monetary = (
        F.col("recency_score"), F.col("frequency_score"), F.col("monetary_score")
    )
    return (
        F.when((recency >= 4) & (frequency >= 4) & (monetary >= 4), "vip")
        .when((recency <= 2) & (frequency >= 3), "at_risk")
        .when((recency >= 4) & (frequency <= 2), "recent")
        .otherwise("standard")
    )


def score_rfm(base: DataFrame) -> DataFrame:
    """Scores and segment for a (customer_id, recency_days, frequency, monetary) frame.

    The edges are fitted first, which reads ``base`` once per narrowing level, so hand
    in a stored frame; scoring itself is then a row-by-row projection.
    """
    own_thread = inheritable_thread_target(base.sparkSession)
    with ThreadPoolExecutor(2) as fits:
        values = fits.submit(own_thread(value_edges), base, "recency_days", "monetary")
        keys = fits.submit(own_thread(frequency_edges), base)
        edges, boundaries = values.result(), keys.result()
    return (
        base.withColumns(
            {
                "recency_score": F.lit(fixed.RFM_BINS + 1) - value_score("recency_days", edges),
                "frequency_score": frequency_score(boundaries),
                "monetary_score": value_score("monetary", edges),
            }
        )
        .withColumn(
            "rfm_score", score_text("recency_score", "frequency_score", "monetary_score")
        )
        .withColumn("segment", rfm_segment())
    )


def customer_rfm(sales: DataFrame) -> DataFrame:
    """RFM table from ``order_sales``: the base is stored once, then scored."""
    return score_rfm(with_recency(cut_lineage(rfm_base(sales))))
