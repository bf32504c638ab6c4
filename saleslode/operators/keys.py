"""Key checks: duplicate members, orphans, sets of names."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleslode.session import collect_garbage, cut_lineage

BROADCAST_KEYS = 200_000


def _repeats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, as ``_key_0`` and on, with ``_repeated``."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1)
        .select(*[F.col(key).alias(f"_key_{i}") for i, key in enumerate(keys)],
                F.lit(True).alias("_repeated"))
    )


def _stored_repeats(df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """``_repeats``, stored, with a broadcast hint where they are few; None if there are none.

    A repeated key has a repeated hash, so only rows of such hashes are grouped by their keys.
    """
    digest = F.xxhash64(*keys)
    hashes = cut_lineage(
        df.groupBy(digest.alias("_hash")).agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1).select("_hash")
    )
    collect_garbage(df.sparkSession)
    found, rows = hashes.count(), df
    if not found:
        return None
    if found <= BROADCAST_KEYS:
        rows = df.join(F.broadcast(hashes), digest == F.col("_hash"), "left_semi")
    repeated = cut_lineage(_repeats(rows, keys))
    collect_garbage(df.sparkSession)
    return F.broadcast(repeated) if repeated.count() <= BROADCAST_KEYS else repeated


def flag_duplicate_keys(df: DataFrame, keys: Sequence[str],
                        out: str = "is_duplicate_key", stored: bool = False) -> DataFrame:
    """Mark every member of a key that occurs more than once; NULL keys equal each other.

    A count window would hold a whole key group in one task. The repeated keys are
    counted with map-side combine instead and joined back, so a key owning a third of
    the rows is one row on the small side and a splittable skewed partition on the
    other; when repeats are few the runtime turns the join into a broadcast, though it may
    have shuffled the rows by then. With ``stored`` the repeated keys are stored and counted
    first, and up to ``BROADCAST_KEYS`` of them are broadcast: the rows are not shuffled. Hashes
    of the keys are counted before them, so that keys whose hash stands once are not shuffled.
    Absent key columns mean no flag can be raised.
    """
    if not keys or any(key not in df.columns for key in keys):
        return df.withColumn(out, F.lit(False))
    if stored:
        repeated = _stored_repeats(df, keys)
        if repeated is None:
            return df.withColumn(out, F.lit(False))
    else:
        repeated = _repeats(df, keys)
    same = reduce(
        and_, [F.col(key).eqNullSafe(F.col(f"_key_{i}")) for i, key in enumerate(keys)]
    )
    return (
        df.join(repeated, same, "left")
        .withColumn(out, F.coalesce("_repeated", F.lit(False)))
        .drop("_repeated", *[f"_key_{i}" for i in range(len(keys))])
    )


def duplicate_key_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row (failed_count, total_count): rows sharing their key, and all rows."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .agg(
            F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("failed_count"),
            F.coalesce(F.sum("_n"), F.lit(0)).alias("total_count"),
        )
    )


def orphan_rows(child: DataFrame, child_key: str, parent: DataFrame,
                parent_key: str) -> DataFrame:
    """One row (failed_count, total_count): child rows whose key has no parent.

    A NULL child key is not an orphan. Both sides are reduced to distinct keys before
    they meet, so a hot key is a single counted row.
    """
    counted = child.groupBy(F.col(child_key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    known = (
        parent.select(F.col(parent_key).alias("_key"))
        .dropna()
        .distinct()
        .withColumn("_known", F.lit(True))
    )
    orphan = F.col("_key").isNotNull() & F.col("_known").isNull()
    return counted.join(known, "_key", "left").agg(
        F.coalesce(F.sum(F.when(orphan, F.col("_n"))), F.lit(0)).alias("failed_count"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_count"),
    )


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """The orphan keys themselves with their row counts (``key``, ``row_count``)."""
    counted = (
        child.where(F.col(child_key).isNotNull())
        .groupBy(F.col(child_key).alias("key"))
        .agg(F.count(F.lit(1)).alias("row_count"))
    )
    known = parent.select(F.col(parent_key).alias("key")).dropna().distinct()
    return counted.join(known, "key", "left_anti")


def missing_names(expected: Iterable[str], present: Iterable[str]) -> list[str]:
    """Expected names that are absent, sorted."""
    return sorted(set(expected).difference(present))
