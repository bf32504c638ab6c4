"""Text expressions. Whitespace means every Unicode space, not only the blank."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE_SPACE = r"(?U)^\s+|\s+$"


def normalised_text(column: Column) -> Column:
    """Trim both ends and lower the case."""
    return F.lower(F.regexp_replace(column.cast("string"), EDGE_SPACE, ""))


def has_text(column: Column) -> Column:
    """True when anything but whitespace is present; NULL counts as empty."""
    return F.coalesce(column.cast("string"), F.lit("")).rlike(r"(?U)\S")


def title_words(column: Column) -> Column:
    """Underscores to blanks, runs of space collapsed, each word capitalised."""
    words = F.trim(F.regexp_replace(F.replace(column, F.lit("_"), F.lit(" ")), r"\s+", " "))
    return F.initcap(words)


def forward_slashes(column: Column) -> Column:
    return F.replace(column, F.lit("\\"), F.lit("/"))


def label_or_self(column: Column, labels: Mapping[str, str]) -> Column:
    """Look the value up in a fixed label table, keep the raw value when absent."""
    pairs = [F.lit(part) for pair in labels.items() for part in pair]
    return F.coalesce(F.create_map(*pairs)[column], column)


def area_of_check(name: Column) -> Column:
    """Monitoring area from a check name's prefix."""
    return (
        F.when(name.startswith("gold_"), F.lit("Gold"))
        .when(name.startswith("model_output_"), F.lit("ML outputs"))
        .when(name.startswith("report_"), F.lit("Relatórios"))
        .otherwise(F.lit("Sistema"))
    )
