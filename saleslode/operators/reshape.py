"""Reshaping, top-k and row-sampling operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_ROWS, MAX_ROWS = 1, 500


def pivot_mean(df: DataFrame, index: str, names: str, value: str,
               values: Sequence[str]) -> DataFrame:
    """Long to wide with the mean per cell; an index whose values are all NULL is dropped."""
    present = df.where(F.col(index).isNotNull() & F.col(value).isNotNull())
    wide = present.groupBy(index).pivot(names, list(values)).agg(F.avg(value))
    return wide.where(F.coalesce(*[F.col(name) for name in values]).isNotNull())


def melt(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str,
         value: str) -> DataFrame:
    """Wide to long."""
    return df.unpivot(list(keys), list(columns), name, value)


def keep_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The listed columns that exist, in the listed order."""
    return df.select(*[column for column in columns if column in df.columns])


def rename_present(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})


def checked_limit(limit: int) -> int:
    """A served page has 1 to 500 rows; other callers ask ``top_rows`` for any number."""
    if not MIN_ROWS <= limit <= MAX_ROWS:
        raise ValueError(f"limit must lie in {MIN_ROWS}..{MAX_ROWS}, got {limit}")
    return limit


def top_rows(df: DataFrame, order: Column | Sequence[Column], limit: int) -> DataFrame:
    """First rows of an ordering; planned as a per-partition top-k and a small merge."""
    keys = list(order) if isinstance(order, (list, tuple)) else [order]
    if limit < 1:
        raise ValueError(f"limit must be positive, got {limit}")
    return df.orderBy(*keys).limit(limit)


def hashed_sample(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """``size`` rows, or all if there are fewer, chosen by hashed key: the same on every run.

    A hash threshold first thins the rows, inside the scan, to the wanted number and six
    standard deviations more, so that the final ordering sees little more than it keeps.
    """
    spread = 1 << 31
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    slot = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(spread))
    share = F.coalesce(F.try_divide(F.lit(size + 6.0 * size ** 0.5 + 30.0), total), F.lit(1.0))
    thinned = df.withColumn("_slot", slot).where(F.col("_slot") < share * spread)
    return thinned.orderBy("_slot", key).limit(size).drop("_slot")
