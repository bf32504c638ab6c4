"""Schemas and row counts of many Parquet files in one job, from their footers alone."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOOTER_SCHEMA = ("path string, opened boolean, error string, rows bigint, "
                 "names array<string>")


def data_files(spark: SparkSession, root: str) -> DataFrame:
    """(path) of every Parquet file below a folder; hidden folders are skipped.

    Spark lists wide folders on executors, and contents are not read.
    """
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", "*.parquet").load(root))
    return found.select("path")


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return pafs.LocalFileSystem(), path.removeprefix("file:").replace("//", "/")
    return pafs.FileSystem.from_uri(quote(path, safe=":/="))


def _footer(path: str) -> tuple:
    """One file's footer; ``opened`` is false if the file itself cannot be reached from here."""
    try:
        system, name = _open(path)
        source = system.open_input_file(name)
    except (OSError, pa.ArrowException) as unreachable:
        return path, False, type(unreachable).__name__, 0, None
    with source:
        try:
            footer = pq.ParquetFile(source)
            return path, True, None, footer.metadata.num_rows, footer.schema_arrow.names
        except (OSError, pa.ArrowException) as broken:
            return path, True, type(broken).__name__, 0, None


def read_footers(paths: DataFrame) -> DataFrame:
    """(path, opened, error, rows, names) of the files of a one-column table of paths."""
    columns = FOOTER_SCHEMA.split(", ")
    types = [pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_footer(path) for path in batch.column(0).to_pylist()]
            values = zip(*rows, strict=True) if rows else [()] * len(types)
            yield pa.record_batch([pa.array(v, t) for v, t in zip(values, types, strict=True)],
                                  names=[c.split(" ")[0] for c in columns])

    return paths.mapInArrow(run, FOOTER_SCHEMA)


def folder_footers(files: DataFrame) -> DataFrame:
    """Footers summed by the files' folder: (folder, files, unreached, broken, error, rows, names).

    ``names`` are the columns of any file, ``shared`` those of every file.
    """
    folder = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    rows = files.withColumn("folder", folder)
    sums = rows.groupBy("folder").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(~F.col("opened")).alias("unreached"),
        F.count_if(F.col("opened") & F.col("error").isNotNull()).alias("broken"),
        F.min("error").alias("error"), F.sum("rows").alias("rows"),
    )
    held = (rows.select("folder", F.explode(F.array_distinct("names")).alias("name"))
            .groupBy("folder", "name").agg(F.count(F.lit(1)).alias("held")))
    lists = held.groupBy("folder").agg(F.collect_list(F.struct("name", "held")).alias("held"))
    named = sums.join(lists, "folder", "left")
    every = F.filter("held", lambda n: n["held"] == F.col("files"))
    return named.select(
        "folder", "files", "unreached", "broken", "error", "rows",
        F.coalesce(F.col("held.name"), F.array().cast("array<string>")).alias("names"),
        F.coalesce(F.transform(every, lambda n: n["name"]),
                   F.array().cast("array<string>")).alias("shared"),
    )
