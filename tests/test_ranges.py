"""Series operators on ranges of rows: same results as on the whole series in one task."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from saleslode.operators import ranges, series

LAGS = {"lag_1": 1, "lag_7": 7}


def windows(rows, order, within=()):
    rows = series.row_lags(rows, order, "value", LAGS, within)
    rows = series.rolling_means(rows, order, "value", {"mean_7": 7}, within)
    rows = series.rolling_deviations(rows, order, "value", {"std_7": 7}, within)
    return series.first_differences(rows, order, {"change": "value"}, within)


def as_rows(df):
    names = sorted(set(df.columns) - {"row_number"})
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


@pytest.mark.parametrize("count", [0, 7, 100])
@pytest.mark.parametrize("size", [1, 10])
def test_ranges_equal_one_task(spark, count, size):
    """Also where ranges are shorter than the reach, end exactly, or hold no value at all."""
    r = random.Random(count)
    data = [(r.random(), i, None if r.random() < 0.3 or 20 <= i < 45
             else float(r.choice([0, 1, 2, 5]))) for i in range(count)]
    df = spark.createDataFrame(data, "at double, id int, value double").repartition(5)
    numbered = ranges.numbered_series(df, [F.col("at"), F.col("id")])
    assert as_rows(ranges.over_ranges(numbered, 7, windows, size)) == as_rows(windows(df, "at"))
    columns = {"growth": "value", "again": "value"}
    assert as_rows(ranges.range_growth(numbered, columns, size)) == as_rows(
        series.growth(df, "at", columns))
    assert as_rows(ranges.range_split(numbered, 0.7)) == as_rows(
        series.temporal_split(df, "at", 0.7))


def test_long_series_in_many_tasks(spark):
    """A series of minutes: lags and means against their closed form, no exchange to one task."""
    minutes = 400_000
    df = spark.range(minutes).select(
        F.timestamp_seconds(F.col("id") * 60).alias("minute"), F.col("id").cast("double")
        .alias("value")).repartition(8)
    numbered = ranges.numbered_series(df, [F.col("minute")])
    got = ranges.over_ranges(numbered, 30, lambda rows, order, within: series.rolling_means(
        series.row_lags(rows, order, "value", {"lag_30": 30}, within),
        order, "value", {"mean_30": 30}, within), 1 << 14)
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    lag = F.when(F.col("value") >= 30, F.col("value") - 30)
    mean = F.when(F.col("value") >= 29, F.col("value") - 14.5).otherwise(F.col("value") / 2)
    wrong = got.where(~F.col("lag_30").eqNullSafe(lag) | (F.abs(F.col("mean_30") - mean) > 1e-6)
                      | (F.col("row_number") != F.col("value") + 1))
    assert got.count() == minutes and wrong.count() == 0
