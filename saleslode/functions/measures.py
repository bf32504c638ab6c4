"""Sums and means whose value does not depend on the order of addition.

Double addition is not associative, so the last digits of a distributed sum change
with partitioning and with task retries. Values are therefore summed as decimals of eight
places (cents times a rate have four), which is exact in any order; the total is rounded
below the precision of the inputs, and means divide it by the count. Values that are no
decimal (not a number, infinite) count as missing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY_DIGITS = 4
RATE_DIGITS = 6
EXACT = "decimal(28,8)"


def line_total() -> Column:
    """Item price plus its freight; NULL when either is missing."""
    return F.col("price") + F.col("freight_value")


def stable_sum(column: Column, digits: int = MONEY_DIGITS) -> Column:
    return F.round(F.sum(column.try_cast(EXACT)).cast("double"), digits)


def mean_from(total: Column, count: Column, digits: int = MONEY_DIGITS) -> Column:
    """Mean from already summed partial totals and counts; no values gives NULL."""
    return F.try_divide(stable_sum(total, digits), F.sum(count))


def stable_mean(column: Column, digits: int = RATE_DIGITS) -> Column:
    return F.try_divide(stable_sum(column, digits), F.count(column))


def sum_when(condition: Column) -> Column:
    """SUM(CASE WHEN condition THEN 1 ELSE 0 END); an unknown condition adds 0."""
    return F.sum(F.when(condition, F.lit(1)).otherwise(F.lit(0)))
