"""Calendar expressions; weeks start on Monday (0) as in ISO 8601."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_day(column: Column) -> Column:
    return column.cast("date")


def month_of(column: Column) -> Column:
    """First day of the month, as a date."""
    return F.trunc(column, "month")


def day_distance(start: Column, end: Column) -> Column:
    """Calendar-day boundaries crossed (23:59 to 00:01 is one day)."""
    return F.datediff(end, start)


def date_key(day: Column) -> Column:
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")


def calendar_columns(day: Column) -> list[Column]:
    """The calendar attributes of one date, in dimension order."""
    weekday = F.weekday(day)
    return [
        date_key(day).alias("date_key"),
        day.alias("date"),
        F.dayofmonth(day).alias("day"),
        weekday.alias("day_of_week"),
        F.date_format(day, "EEEE").alias("day_name"),
        F.weekofyear(day).alias("week"),
        F.month(day).alias("month"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.quarter(day).alias("quarter"),
        F.year(day).alias("year"),
        (weekday >= 5).alias("is_weekend"),
    ]
