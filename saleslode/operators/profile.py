"""Dataset profile: size, exact duplicates and per-column completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile_columns(df: DataFrame) -> DataFrame:
    """(column, dtype, null_count, null_ratio, unique_count) for every column.

    The cells are counted per (column, 256-bit hash of the value) with map-side combine,
    which yields the NULL and the distinct counts of all columns in one pass; values, long
    texts among them, stay where they are.
    """
    cells = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(field.name).alias("column"),
                        F.lit(field.dataType.simpleString()).alias("dtype"),
                        F.unhex(F.sha2(F.col(f"`{field.name}`").cast("string"), 256))
                        .alias("value"),
                    )
                    for field in df.schema.fields
                ]
            )
        ).alias("cell")
    ).select("cell.*")
    counted = cells.groupBy("column", "dtype", "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("column", "dtype").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias(
            "null_count"
        ),
        F.coalesce(
            F.try_divide(
                F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)),
                F.sum("n"),
            ),
            F.lit(0.0),
        ).alias("null_ratio"),
        F.count("value").alias("unique_count"),
    )


def profile_summary(df: DataFrame) -> DataFrame:
    """One row (rows, columns, duplicate_rows); repeats count beyond the first.

    Rows are compared by a 256-bit hash.
    """
    whole = F.to_json(F.struct(*[F.col(f"`{name}`") for name in df.columns]))
    return (
        df.groupBy(F.unhex(F.sha2(whole, 256)).alias("_row"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
            F.lit(len(df.columns)).alias("columns"),
            F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
        )
    )


def profile_record(df: DataFrame) -> DataFrame:
    """The whole profile as one row, column profiles nested in name order."""
    columns = profile_columns(df).agg(
        F.sort_array(
            F.collect_list(F.struct("column", "dtype", "null_count", "null_ratio", "unique_count"))
        ).alias("column_profiles")
    )
    return profile_summary(df).withColumn("column_profiles", columns.scalar())
