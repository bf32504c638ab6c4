"""Boolean flags with NULL resolved, so a flag is always true or false."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def after(left: Column, right: Column) -> Column:
    """left > right; an absent side gives false."""
    return truthy(left > right)


def before(left: Column, right: Column) -> Column:
    """left < right; an absent side gives false."""
    return truthy(left < right)


def missing_or_negative(number: Column) -> Column:
    return number.isNull() | F.isnan(number.cast("double")) | (number < 0)


def not_accepted(column: Column, accepted: Iterable[str]) -> Column:
    """True for NULL and for every value outside the accepted set."""
    return ~truthy(column.cast("string").isin(sorted(accepted)))
