"""Batch-versioned datasets: ``{layer}/{source}/{dataset}/batch_id={id}``.

A dataset's current content is its newest batch as a whole; older batches are kept
but never merged in. Finding it reads folder metadata only, so the cost does not
grow with the size of the history's data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from saleslode.settings import SOURCES
from saleslode.sources import files

BATCH_PREFIX = "batch_id="


class DatasetNotFound(FileNotFoundError):
    """No such dataset, batch or report."""


def read_columns(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan, optionally of some columns only."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def batches(spark: SparkSession, dataset_dir: str) -> list[files.Entry]:
    """Batch folders, oldest first by modification time, then by name."""
    found = [e for e in files.entries(spark, dataset_dir)
             if e.is_dir and e.name.startswith(BATCH_PREFIX)]
    return sorted(found, key=lambda entry: (entry.modified_ms, entry.name))


def latest_batch(spark: SparkSession, dataset_dir: str) -> str:
    """Id of the newest batch; raises when there is none."""
    found = batches(spark, dataset_dir)
    if not found:
        raise DatasetNotFound(f"No batch found in {dataset_dir}")
    return found[-1].name.removeprefix(BATCH_PREFIX)


def read_latest(spark: SparkSession, dataset_dir: str) -> DataFrame:
    """The newest batch, with ``batch_id`` restored as a column."""
    batch = latest_batch(spark, dataset_dir)
    return spark.read.option("basePath", dataset_dir).parquet(
        f"{dataset_dir}/{BATCH_PREFIX}{batch}"
    )


def datasets_below(spark: SparkSession, root: str) -> list[str]:
    """Names of the datasets of a source that hold a batch; ``_`` folders are skipped."""
    return [
        entry.name
        for entry in files.entries(spark, root)
        if entry.is_dir and not entry.name.startswith("_") and batches(spark, entry.path)
    ]


def read_latest_below(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Newest batch of every dataset of a source, by dataset name."""
    return {name: read_latest(spark, f"{root}/{name}") for name in datasets_below(spark, root)}


def register_views(spark: SparkSession, layer_dir: str,
                   sources: Sequence[str] = SOURCES) -> list[str]:
    """Create a temp view ``{source}_{dataset}`` per current dataset; returns the names."""
    names = []
    for source in sources:
        for dataset, df in read_latest_below(spark, f"{layer_dir}/{source}").items():
            df.createOrReplaceTempView(f"{source}_{dataset}")
            names.append(f"{source}_{dataset}")
    return names


def read_dataset(spark: SparkSession, layer_dir: str, dataset: str) -> DataFrame:
    """A single-version dataset (Gold or model output) by name."""
    path = f"{layer_dir}/{dataset}"
    if not files.exists(spark, path):
        raise DatasetNotFound(f"Dataset not found: {dataset}")
    try:
        return spark.read.parquet(path)
    except AnalysisException as unreadable:
        raise DatasetNotFound(f"Dataset not readable: {dataset}") from unreadable
