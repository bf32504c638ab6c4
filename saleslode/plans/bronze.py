"""Bronze: raw records plus load metadata, one batch per ingestion call."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslode import settings as fixed
from saleslode.session import cut_lineage
from saleslode.settings import Layout, SeriesIndicator, StatisticsIndicator
from saleslode.sources import files, footers, lake, landing
from saleslode.sinks.writers import BatchManifest, TableManifest, append_batch, new_batch_id


def with_load_metadata(df: DataFrame, source: str, batch_id: str, loaded_at: datetime,
                       source_file: str | None = None) -> DataFrame:
    """Add source, source_file (files only), ingestion_timestamp and batch_id."""
    columns = {"source": F.lit(source)}
    if source_file is not None:
        columns["source_file"] = F.lit(source_file)
    columns["ingestion_timestamp"] = F.lit(loaded_at)
    columns["batch_id"] = F.lit(batch_id)
    return df.withColumns(columns)


def _load(frames: Mapping[str, tuple[DataFrame, str, str | None]], layout: Layout, folder: str,
          source: str, missing: Sequence[str] = ()) -> BatchManifest:
    """Append every frame as one shared batch and write the manifest."""
    batch_id, started = new_batch_id(folder), datetime.now(UTC)
    tables = []
    spark: SparkSession | None = None
    for dataset, (df, reference, source_file) in frames.items():
        spark = df.sparkSession
        loaded = with_load_metadata(df, source, batch_id, started, source_file)
        destination = f"{layout.bronze}/{folder}/{dataset}"
        rows = append_batch(loaded, destination, batch_id)
        tables.append(TableManifest(dataset, f"{destination}/batch_id={batch_id}", rows,
                                    len(loaded.columns), reference))
    manifest = BatchManifest(batch_id, source, started, datetime.now(UTC), tuple(tables),
                             tuple(missing))
    if spark is not None:
        manifest.to_frame(spark).coalesce(1).write.mode("overwrite").json(
            f"{layout.bronze}/{folder}/_manifests/{batch_id}"
        )
    return manifest


def ingest_sales_csvs(spark: SparkSession, source_dir: str, layout: Layout) -> BatchManifest:
    """Load the expected CSV files that exist; the others are listed as missing."""
    found, missing = landing.scan_expected_csvs(spark, source_dir)
    frames = {
        dataset: (df, f"{source_dir}/{fixed.EXPECTED_FILES[dataset]}",
                  fixed.EXPECTED_FILES[dataset])
        for dataset, df in found.items()
    }
    return _load(frames, layout, fixed.SALES_SOURCE, fixed.SALES_SOURCE, missing)


def ingest_series(spark: SparkSession, landed: Mapping[str, str], layout: Layout,
                  indicators: Sequence[SeriesIndicator] = fixed.SERIES_INDICATORS,
                  start: str | None = None, end: str | None = None,
                  lines: bool = False) -> BatchManifest:
    """Load indicator series from landed JSON ({indicator name: path}), one batch."""
    frames = {
        i.name: (
            landing.scan_series(spark, landed[i.name], i.series_code, start, end, lines).withColumn(
                "indicator_name", F.lit(i.name)
            ),
            str(i.series_code), None,
        )
        for i in indicators
    }
    return _load(frames, layout, fixed.SERIES_SOURCE, fixed.SERIES_SOURCE_LABEL)


def ingest_statistics(spark: SparkSession, landed: Mapping[str, str], layout: Layout,
                      indicators: Sequence[StatisticsIndicator] = fixed.STATISTICS_INDICATORS,
                      lines: bool = False) -> BatchManifest:
    """Load statistics tables from landed JSON ({indicator name: path}), one batch."""
    frames = {
        i.name: (
            landing.scan_statistics(spark, landed[i.name], lines).withColumn(
                "indicator_name", F.lit(i.name)
            ),
            f"{i.table}/{i.path}", None,
        )
        for i in indicators
    }
    return _load(frames, layout, fixed.STATISTICS_SOURCE, fixed.STATISTICS_SOURCE_LABEL)


def ingest_one_series(spark: SparkSession, path: str, indicator: SeriesIndicator,
                      layout: Layout, start: str | None = None, end: str | None = None,
                      lines: bool = False) -> BatchManifest:
    """Load one series; its batch replaces that of an earlier load of several."""
    return ingest_series(spark, {indicator.name: path}, layout, (indicator,), start, end, lines)


def ingest_one_statistics(spark: SparkSession, path: str, indicator: StatisticsIndicator,
                          layout: Layout, lines: bool = False) -> BatchManifest:
    """Load one statistics table."""
    return ingest_statistics(spark, {indicator.name: path}, layout, (indicator,), lines)


CHECK_SCHEMA = (
    "path string, passed boolean, rows bigint, columns bigint, "
    "missing_columns array<string>, message string"
)
UNREADABLE = "Could not read parquet file: "


def check_batch(spark: SparkSession, path: str) -> tuple:
    """Required load columns and rows of one batch, read by Spark itself.

    For file systems that the workers' Parquet library cannot reach.
    """
    try:
        df = spark.read.option("basePath", path.rsplit("/", 1)[0]).parquet(path)
        rows = df.count()
    except Exception as unreadable:  # noqa: BLE001 - any read error is a finding
        return (path, False, 0, 0, list(fixed.BRONZE_REQUIRED),
                UNREADABLE + type(unreadable).__name__)
    missing = sorted(set(fixed.BRONZE_REQUIRED).difference(df.columns))
    message = f"Missing required bronze columns: {missing}" if missing else "passed"
    return (path, not missing, rows, len(df.columns), missing, message)


def check_batches(spark: SparkSession, root: str, batches: Sequence[str]) -> DataFrame:
    """Checks of the batch folders below ``root``, from the footers of all their files at once.

    A required column must be in every file of its batch; the folder's name gives ``batch_id``.
    One unreadable file, or none at all, fails its batch. ``reached`` is false where a worker
    could not open a file.
    """
    listed = spark.createDataFrame([(b,) for b in batches], "path string")
    found = footers.folder_footers(footers.read_footers(footers.data_files(spark, root)))
    own = F.array(F.lit(lake.BATCH_PREFIX.rstrip("=")))
    required = F.array(*[F.lit(name) for name in sorted(fixed.BRONZE_REQUIRED)])
    checks = listed.join(found, F.col("path") == F.col("folder"), "left").select(
        "path", (F.coalesce("unreached", F.lit(0)) == 0).alias("reached"),
        (F.coalesce("files", F.lit(0)) - F.coalesce("broken", F.lit(0)) > 0).alias("any"),
        (F.coalesce("broken", F.lit(0)) == 0).alias("whole"),
        F.coalesce("error", F.lit("no data file")).alias("error"), "rows",
        F.size(F.array_union("names", own)).alias("columns"),
        F.array_except(required, F.array_union("shared", own)).alias("absent"),
    ).withColumn("readable", F.col("any") & F.col("whole"))
    readable, complete = F.col("readable"), F.size("absent") == 0
    lacking = F.concat(F.lit("Missing required bronze columns: ['"),
                       F.concat_ws("', '", "absent"), F.lit("']"))
    return checks.select(
        "path", "reached", (readable & complete).alias("passed"),
        F.when(readable, F.col("rows")).otherwise(0).alias("rows"),
        F.when(readable, F.col("columns")).otherwise(0).cast("bigint").alias("columns"),
        F.when(readable, F.col("absent")).otherwise(required).alias("missing_columns"),
        F.when(~readable, F.concat(F.lit(UNREADABLE), F.col("error")))
        .when(complete, "passed").otherwise(lacking).alias("message"),
    )


def validate_bronze(spark: SparkSession, layout: Layout) -> DataFrame:
    """One check row per batch of every dataset of every source; the jobs do not depend on
    how many batches there are. The driver lists the names of batch folders only."""
    targets = [
        batch.path
        for source in fixed.SOURCES
        for entry in files.entries(spark, f"{layout.bronze}/{source}")
        if entry.is_dir and not entry.name.startswith("_")
        for batch in lake.batches(spark, entry.path)
    ]
    if not targets:
        return spark.createDataFrame([], CHECK_SCHEMA)
    checks = cut_lineage(check_batches(spark, layout.bronze, targets))
    apart = [row["path"] for row in checks.where("not reached").select("path").collect()]
    by_footers = checks.where("reached").drop("reached")
    if not apart:
        return by_footers
    return by_footers.union(
        spark.createDataFrame([check_batch(spark, path) for path in apart], CHECK_SCHEMA)
    )


def bronze_verdict(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.count(F.lit(1)).alias("files_checked"),
        F.count_if(~F.col("passed")).alias("files_failed"),
        (F.count_if(~F.col("passed")) == 0).alias("passed"),
    )
