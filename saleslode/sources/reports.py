"""Reports: JSON written under ``{folder}/{prefix}{stamp}``; the newest name is current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from saleslode.settings import REPORT_KINDS, SERVED_REPORTS, Layout
from saleslode.sources import files
from saleslode.sources.lake import DatasetNotFound


def latest_report_path(spark: SparkSession, base: str, prefix: str) -> str | None:
    """Lexicographically last report of a kind (names end in a UTC stamp)."""
    folder, _, stem = f"{base}/{prefix}".rpartition("/")
    names = [e.name for e in files.entries(spark, folder) if e.name.startswith(stem)]
    return f"{folder}/{names[-1]}" if names else None


def latest_report(spark: SparkSession, layout: Layout, kind: str) -> DataFrame:
    """Payload of the newest report of a served kind."""
    if kind not in SERVED_REPORTS:
        raise DatasetNotFound(f"Unknown report type: {kind}")
    layer, prefix = REPORT_KINDS[kind]
    path = latest_report_path(spark, layout.folder(layer), prefix)
    if path is None:
        raise DatasetNotFound(f"No reports found for type: {kind}")
    return spark.read.json(path)
