"""Scans of landed raw files, all distributed and schema-tolerant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saleslode.functions import decimal_comma_number, fixed_date
from saleslode.settings import EXPECTED_FILES, MISSING_MARKERS, MULTILINE_DATASETS
from saleslode.sources import files

SERIES_SCHEMA = "data string, valor string"
STATISTICS_FIELDS = ("D1C", "D1N", "D2C", "D2N", "D3C", "D3N", "MC", "MN", "NC", "NN", "V")


def scan_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """CSV with header, every column a string, missing-value markers as NULL.

    Typing belongs to Silver. A file is read in parallel splits, except where cells
    may hold line breaks (``multiline``): such a file is one split, so land a large
    extract of that kind as several files and pass their folder.
    """
    raw = (
        spark.read.option("header", True)
        .option("multiLine", multiline)
        .option("escape", '"')
        .option("inferSchema", False)
        .csv(path)
    )
    return raw.select(
        *[
            F.when(~F.col(f"`{name}`").isin(*MISSING_MARKERS), F.col(f"`{name}`")).alias(name)
            for name in raw.columns
        ]
    )


def scan_expected_csvs(spark: SparkSession,
                       source_dir: str) -> tuple[dict[str, DataFrame], list[str]]:
    """The expected files that exist, by dataset, and the names of the missing ones."""
    found, missing = {}, []
    for dataset, file_name in EXPECTED_FILES.items():
        path = f"{source_dir}/{file_name}"
        if files.exists(spark, path):
            found[dataset] = scan_csv(spark, path, dataset in MULTILINE_DATASETS)
        else:
            missing.append(file_name)
    return found, missing


def scan_series(spark: SparkSession, path: str, series_code: int, start: str | None = None,
                end: str | None = None, lines: bool = False) -> DataFrame:
    """Indicator series (date dd/MM/yyyy, decimal comma) as (date, value, series_code).

    ``start`` and ``end`` are dd/MM/yyyy and bound the dates, both included. ``lines`` reads
    one record a line, which splits; without it a file is one array and one task.
    """
    return typed_series(
        spark.read.schema(SERIES_SCHEMA).option("multiLine", not lines).json(path),
        series_code, start, end,
    )


def typed_series(raw: DataFrame, series_code: int, start: str | None = None,
                 end: str | None = None) -> DataFrame:
    typed = raw.select(
        fixed_date(F.col("data"), "dd/MM/yyyy").alias("date"),
        decimal_comma_number(F.col("valor")).alias("value"),
        F.lit(series_code).cast("bigint").alias("series_code"),
    )
    if start:
        typed = typed.where(F.col("date") >= fixed_date(F.lit(start), "dd/MM/yyyy"))
    if end:
        typed = typed.where(F.col("date") <= fixed_date(F.lit(end), "dd/MM/yyyy"))
    return typed


def scan_statistics(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Statistics table: every field a string, the header row still included."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in STATISTICS_FIELDS])
    return spark.read.schema(schema).option("multiLine", not lines).json(path)
