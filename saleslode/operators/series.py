"""Operators over ordered rows: lags, rolling statistics, growth, differences.

Without a partition key each runs in one task. That is meant for a series aggregated to one
row per calendar day or month: a century is 36,525 rows, and the whole date range 0001-9999
is 3.65 million, however many source rows there are. Longer series (events, orders) go
through ``ranges``, which gives the same results on many ranges of consecutive rows.
``within`` names the partition columns there.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saleslode.functions import MONEY_DIGITS


def row_lags(df: DataFrame, order: str, value: str, lags: Mapping[str, int],
             within: Sequence[str] = ()) -> DataFrame:
    """Value n rows earlier. Counts rows, not calendar days: gaps are skipped."""
    by_order = Window.partitionBy(*within).orderBy(order)
    return df.withColumns({name: F.lag(value, n).over(by_order) for name, n in lags.items()})


def rolling_means(df: DataFrame, order: str, value: str, spans: Mapping[str, int],
                  within: Sequence[str] = ()) -> DataFrame:
    """Mean of the last n rows; the first rows use what there is."""
    by_order = Window.partitionBy(*within).orderBy(order)

    def mean(n: int) -> Column:
        last_n = by_order.rowsBetween(1 - n, 0)
        total = F.round(F.sum(value).over(last_n), MONEY_DIGITS)
        return F.try_divide(total, F.count(value).over(last_n))

    return df.withColumns({name: mean(n) for name, n in spans.items()})


def rolling_deviations(df: DataFrame, order: str, value: str,
                       spans: Mapping[str, int],
                       within: Sequence[str] = ()) -> DataFrame:
    """Sample standard deviation of the last n rows; NULL below two values."""
    by_order = Window.partitionBy(*within).orderBy(order)
    return df.withColumns(
        {
            name: F.stddev_samp(value).over(by_order.rowsBetween(1 - n, 0))
            for name, n in spans.items()
        }
    )


def growth(df: DataFrame, order: str, columns: Mapping[str, str]) -> DataFrame:
    """Change against the previous row as a ratio, for {output: input} columns.

    A gap in the input is filled with the last value seen. The first row, and a row
    after a zero, give NULL.
    """
    by_order = Window.orderBy(order)
    so_far = by_order.rowsBetween(Window.unboundedPreceding, 0)
    filled = {f"_filled_{out}": F.last(F.col(src), ignorenulls=True).over(so_far)
              for out, src in columns.items()}
    held = df.withColumns(filled)
    ratios = {
        out: F.try_divide(F.col(f"_filled_{out}"), F.lag(f"_filled_{out}").over(by_order)) - 1
        for out in columns
    }
    return held.withColumns(ratios).drop(*filled)


def first_differences(df: DataFrame, order: str, columns: Mapping[str, str],
                      within: Sequence[str] = ()) -> DataFrame:
    """Value minus the previous row's value, for the {output: input} columns present."""
    by_order = Window.partitionBy(*within).orderBy(order)
    present = {out: src for out, src in columns.items() if src in df.columns}
    return df.withColumns(
        {out: F.col(src) - F.lag(src).over(by_order) for out, src in present.items()}
    )


def temporal_split(df: DataFrame, order: str, train_share: float) -> DataFrame:
    """Add ``row_index`` (0-based) and ``is_train`` for the leading share of the rows."""
    by_order = Window.orderBy(order)
    everything = Window.partitionBy()
    cut = F.floor(F.count(F.lit(1)).over(everything) * F.lit(train_share))
    return df.withColumn("row_index", F.row_number().over(by_order) - 1).withColumn(
        "is_train", F.col("row_index") < cut
    )


def calendar_days(bounds: DataFrame, first: str, last: str) -> DataFrame:
    """Every day between the two dates of a one-row frame, both included."""
    return bounds.select(
        F.explode(F.sequence(F.col(first), F.col(last), F.expr("interval 1 day"))).alias("date")
    )


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))
