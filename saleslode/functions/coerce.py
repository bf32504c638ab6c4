"""Lenient typing: a value that cannot be read becomes NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Plain decimal or scientific notation, or a signed infinity. Spark's own string cast
# also reads Java suffixes such as "1d", which must count as unreadable here.
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"
ISO_DAY_PATTERN = r"^\s*\d{4}-\d{2}-\d{2}"


def to_number(column: Column, dtype: T.DataType | None = None) -> Column:
    """String to double, unreadable to NULL; numeric input is only widened."""
    if dtype is not None and isinstance(dtype, T.NumericType):
        return column.cast("double")
    text = column.cast("string")
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))


def number_column(df: DataFrame, name: str) -> Column:
    """``to_number`` using the column's own type to skip the pattern test."""
    return to_number(F.col(name), df.schema[name].dataType)


def to_integer(column: Column, dtype: T.DataType | None = None) -> Column:
    """Nullable 64-bit integer; fractional input becomes NULL."""
    if dtype is not None and isinstance(dtype, T.IntegralType):
        return column.cast("bigint")
    number = to_number(column, dtype)
    return F.when(number == F.floor(number), number.try_cast("bigint"))


def to_timestamp_lenient(column: Column, dtype: T.DataType | None = None) -> Column:
    """ISO text to timestamp without zone; any other layout becomes NULL."""
    if dtype is not None and isinstance(dtype, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return column.cast("timestamp_ntz")
    text = column.cast("string")
    return F.when(text.rlike(ISO_DAY_PATTERN), F.trim(text).try_cast("timestamp_ntz"))


def fixed_date(column: Column, pattern: str) -> Column:
    """Date in one declared layout, otherwise NULL."""
    return F.try_to_timestamp(column, F.lit(pattern)).cast("date")


def decimal_comma_number(column: Column) -> Column:
    """Number written with a decimal comma."""
    return to_number(F.replace(column, F.lit(","), F.lit(".")))


def is_finite(column: Column) -> Column:
    """Neither NULL, NaN nor infinite."""
    number = column.cast("double")
    return F.coalesce(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), F.lit(False))
