"""Outlier operators: global z-score flags and interquartile-range summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleslode.functions import is_finite, to_number
from saleslode.operators import radix
from saleslode.operators.ranking import (
    QUARTILES,
    prefix_counts,
    quantile_prefixes,
    quantiles_inside,
    with_prefix,
)
from saleslode.session import cut_lineage

FENCE = 1.5


def zscore_flags(df: DataFrame, columns: Sequence[str], threshold: float = 3.0,
                 suffix: str = "_zscore_anomaly") -> DataFrame:
    """Add ``{column}{suffix}``: further than ``threshold`` population deviations away.

    Only finite values count; with fewer than two, or no spread, nothing is flagged.
    The moments of all columns come from one aggregation read back as a scalar.
    """
    types = {name: df.schema[name].dataType for name in columns}

    def finite(name: str):
        number = to_number(F.col(name), types[name])
        return F.when(is_finite(number), number)

    moments = df.agg(
        F.struct(
            *[
                F.struct(
                    F.count(finite(name)).alias("n"),
                    F.avg(finite(name)).alias("mean"),
                    F.stddev_pop(finite(name)).alias("spread"),
                ).alias(name)
                for name in columns
            ]
        ).alias("moments")
    ).scalar()
    flags = {}
    for name in columns:
        stats = moments[name]
        far = F.try_divide(F.abs(finite(name) - stats["mean"]), stats["spread"]) > F.lit(threshold)
        flags[f"{name}{suffix}"] = F.coalesce(far & (stats["n"] >= 2), F.lit(False))
    return df.withColumns(flags)


def _fences(q1: Column, q3: Column) -> tuple[Column, Column]:
    iqr = q3 - q1
    return q1 - FENCE * iqr, q3 + FENCE * iqr


def _brackets(hits: DataFrame, by: list[str]) -> DataFrame:
    """(by..., _low1, _low2, _high1, _high2): prefixes between which each fence must lie.

    A quartile lies between the ends of the prefixes that hold its two ranks. The fences rise
    and fall with the quartiles, and so do their rounded results, so the ends give bounds.
    """
    first, last = radix.prefix_range(F.col("_prefix"))
    held = hits.select(*by, "total", F.explode("_wanted.rank").alias("_rank"),
                       radix.radix_value(first).alias("_from"), radix.radix_value(last).alias("_to"))
    # negative keys: the smaller key is the smaller value on both sides of zero
    near1 = F.col("_rank") <= F.floor((F.col("total") - 1) / 4) + 1
    near3 = F.col("_rank") >= F.floor((F.col("total") - 1) * 3 / 4)
    ends = held.groupBy(*by).agg(
        F.min(F.when(near1, F.col("_from"))).alias("a1"),
        F.max(F.when(near1, F.col("_to"))).alias("b1"),
        F.min(F.when(near3, F.col("_from"))).alias("a3"),
        F.max(F.when(near3, F.col("_to"))).alias("b3"))
    a1, b1, a3, b3 = (F.col(c) for c in ("a1", "b1", "a3", "b3"))
    ends = ends.select(*by, *[v.alias(k) for k, v in {
        "_low1": a1 - FENCE * (b3 - a1), "_low2": b1 - FENCE * (a3 - b1),
        "_high1": a3 + FENCE * (a3 - b1), "_high2": b3 + FENCE * (b3 - a1)}.items()])
    for name in ("_low1", "_low2", "_high1", "_high2"):
        ends = radix.with_radix_key(ends, name, "_key").withColumn(
            name, radix.prefix(F.col("_key"))).drop("_key")
    return ends


def iqr_summaries(values: DataFrame, value: str, by: Sequence[str],
                  few_groups: bool = False) -> DataFrame:
    """Quartiles, fences and outlier counts of a long frame (by..., value).

    Quartiles are exact, and ``values`` is read twice. The first reading counts values by the
    leading half of their keys, which shows where the quartiles and both fences must lie;
    the second gathers, as counted values, what lies under those prefixes only. All other
    prefixes are wholly inside or outside the fences, so their counts are enough. Tables of
    one row per group are broadcast only where the groups are a fixed list.
    """
    by = list(by)
    dtype = values.schema[value].dataType
    number = to_number(F.col(value), dtype)
    finite = values.select(*by, F.when(is_finite(number), number).alias("_value"))
    counts = cut_lineage(prefix_counts(finite, "_value", by))
    hits = cut_lineage(quantile_prefixes(counts, QUARTILES, by, few_groups))

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few_groups else df

    brackets = cut_lineage(_brackets(hits, by))
    looked_at = hits.groupBy(*by).agg(F.collect_set("_prefix").alias("_hit")).join(
        small(brackets), by)
    near_low = F.col("_prefix").between(F.col("_low1"), F.col("_low2"))
    near_high = F.col("_prefix").between(F.col("_high1"), F.col("_high2"))
    inside = cut_lineage(
        with_prefix(finite.where(F.col("_value").isNotNull())
                    .select(*by, F.col("_value").alias("_exact")), "_exact")
        .join(small(looked_at), by)
        .where(F.array_contains("_hit", F.col("_prefix")) | near_low | near_high)
        .groupBy(*by, "_prefix", "_exact").agg(F.count(F.lit(1)).alias("_n"))
    )
    quartiles = cut_lineage(quantiles_inside(inside, hits, QUARTILES, by, "_q", few_groups))
    lower, upper = _fences(F.col("_q")[0], F.col("_q")[1])
    fenced = quartiles.select(
        *by, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("q3"),
        (F.col("_q")[1] - F.col("_q")[0]).alias("iqr"), lower.alias("lower_bound"),
        upper.alias("upper_bound")).join(small(brackets), by)
    figures = ["q1", "q3", "iqr", "lower_bound", "upper_bound"]
    edges = ["_low1", "_low2", "_high1", "_high2"]
    # beyond a bracket whole prefixes are outliers; within it values are compared
    whole = F.when((F.col("_prefix") < F.col("_low1")) | (F.col("_prefix") > F.col("_high2")),
                   F.col("_n")).otherwise(0)
    totals = counts.join(small(fenced), by, "left").groupBy(*by).agg(
        *[F.first(name, ignorenulls=True).alias(name) for name in figures],
        F.coalesce(F.sum(whole), F.lit(0)).alias("_whole"),
        F.coalesce(F.sum(F.when(F.col("_prefix").isNotNull(), F.col("_n"))), F.lit(0))
        .alias("total_count"))
    outside = ((near_low & (F.col("_exact") < F.col("lower_bound")))
               | (near_high & (F.col("_exact") > F.col("upper_bound"))))
    single = inside.join(small(fenced.select(*by, "lower_bound", "upper_bound", *edges)), by
                         ).where(outside).groupBy(*by).agg(F.sum("_n").alias("_single"))
    return totals.join(small(single), by, "left").select(
        *by, *figures,
        (F.col("_whole") + F.coalesce("_single", F.lit(0))).alias("outlier_count"),
        "total_count",
    ).withColumn("outlier_ratio", F.coalesce(
        F.try_divide(F.col("outlier_count"), F.col("total_count")), F.lit(0.0)))
