"""Folder metadata through the Hadoop file system of the session.

Only names and modification times are read here, never data, and only one level of
a folder at a time; it works alike for local disks, HDFS and object stores.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Entry:
    path: str
    name: str
    is_dir: bool
    modified_ms: int


def _handle(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _handle(spark, path)
    return bool(system.exists(target))


def entries(spark: SparkSession, path: str) -> list[Entry]:
    """Children of a folder in name order; an absent folder has none."""
    system, target = _handle(spark, path)
    if not system.exists(target):
        return []
    found = [
        Entry(
            status.getPath().toString(),
            status.getPath().getName(),
            bool(status.isDirectory()),
            int(status.getModificationTime()),
        )
        for status in system.listStatus(target)
    ]
    return sorted(found, key=lambda entry: entry.name)


def modified_ms(spark: SparkSession, path: str) -> int:
    """Newest modification time of a file, or of a folder and its direct children."""
    system, target = _handle(spark, path)
    own = int(system.getFileStatus(target).getModificationTime())
    if not system.getFileStatus(target).isDirectory():
        return own
    return max([own, *[entry.modified_ms for entry in entries(spark, path)]])
