"""Order-preserving 64-bit keys of doubles, cut into four digits of 16 bits.

The key of a double is its IEEE 754 bit pattern (sign, exponent, fraction), negated for
negative numbers, so keys compare as the values do and -0.0 equals 0.0. It is made by exact
arithmetic of built-in functions: scaling by a power of two loses no bit. Each digit has at
most 65,536 values whatever the data, so counting digit by digit narrows any rank down with
bounded tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGIT_BITS = 16
FRACTION_BITS, BIAS = 52, 1023
FRACTION = 1 << FRACTION_BITS
PREFIX_BITS = 32


def _power_of_two(exponent: Column) -> Column:
    return F.pow(F.lit(2.0), exponent)


def with_radix_key(df: DataFrame, value: str, out: str) -> DataFrame:
    """``df`` with the signed 64-bit key of a double column.

    NULL stays NULL, and NaN ranks above infinity. The steps are columns of their own,
    so that none is written out more than once in the plan.
    """
    v, size, low, scaled = (F.col(n) for n in (value, "_size", "_low", "_scaled"))
    top = (2 * BIAS + 1) << FRACTION_BITS
    stepped = df.withColumn("_size", F.when(F.abs(v) < float("inf"), F.abs(v)))
    # zero has no logarithm and takes the least exponent; others may be one off beside a
    # power of two, which the last step mends
    stepped = stepped.withColumn("_low", F.least(
        F.greatest(F.floor(F.log2(size)), F.lit(1 - BIAS)), F.lit(BIAS)).cast("bigint"))
    stepped = stepped.withColumn("_scaled", size / _power_of_two(low))

    def bits(shift: int):
        return (low + (BIAS - 1 + shift)) * FRACTION + (
            scaled * float(FRACTION / 2.0 ** shift)).cast("bigint")

    stepped = stepped.withColumn("_bits", F.when(scaled >= 2.0, bits(1)).when(
        (scaled < 1.0) & (low > 1 - BIAS), bits(-1)).otherwise(bits(0)))
    whole = F.coalesce("_bits", F.when(F.isnan(v), F.lit(top + 1)).when(
        v.isNotNull(), F.lit(top)))
    return stepped.withColumn("_bits", whole).withColumn(
        out, F.when(v < 0, -F.col("_bits")).otherwise(F.col("_bits"))).drop(
        "_size", "_low", "_scaled", "_bits")


def radix_value(key: Column) -> Column:
    """The double of a key; the inverse of ``with_radix_key``."""
    bits = F.abs(key)
    exponent = F.shiftright(bits, FRACTION_BITS)
    fraction = bits.bitwiseAND(F.lit(FRACTION - 1)).cast("double") / float(FRACTION)
    size = F.when(exponent == 0, fraction * _power_of_two(F.lit(1 - BIAS))).otherwise(
        (fraction + 1.0) * _power_of_two(F.least(exponent - BIAS, F.lit(BIAS))))
    size = F.when(exponent > 2 * BIAS,
                  F.when(fraction > 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
                  ).otherwise(size)
    return F.when(key < 0, -size).otherwise(size)


def prefix(key: Column) -> Column:
    """The upper two digits as one signed number."""
    return F.shiftright(key, 64 - PREFIX_BITS)


def digit(number: Column, place: int) -> Column:
    """Digit of a key (or prefix) ``place`` digits from its right; the first has the sign."""
    return F.shiftright(number, DIGIT_BITS * place).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))


def leading_digit(number: Column, places: int) -> Column:
    """The signed first digit of a number of ``places`` digits."""
    return F.shiftright(number, DIGIT_BITS * (places - 1))


def prefix_range(number: Column) -> tuple[Column, Column]:
    """Smallest and largest key under a prefix."""
    first = F.shiftleft(number.cast("bigint"), 64 - PREFIX_BITS)
    return first, first + ((1 << (64 - PREFIX_BITS)) - 1)
