"""The warehouse as versions behind one pointer: a load is seen whole or not at all.

A load writes all tables to a schema of its own, checks the constraints on what was written,
and only then moves the pointer, a property of the public schema: one metadata operation. A load
that fails leaves the pointer and the tables behind it as they were, and removes its own
schema. Readers resolve the pointer once and so see tables of one load; the public schema
also has a view per table for SQL users, moved right after the pointer. The version before
the current one is kept for readers that still use it, older ones are dropped.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from saleslode.sinks.writers import observed

CURRENT, PREVIOUS = "star_current", "star_previous"


class NotLoaded(LookupError):
    """The schema has no finished load."""


def _pointers(spark: SparkSession, schema: str) -> dict[str, str]:
    described = {r["info_name"]: r["info_value"]
                 for r in spark.sql(f"describe schema extended {schema}").collect()}
    listed = re.findall(r"\((star_\w+),\s*(\w+)\)", described.get("Properties") or "")
    return dict(listed)


def load_star(spark: SparkSession, tables: Mapping[str, DataFrame], schema: str = "analytics",
              check: Callable[[Mapping[str, DataFrame]], None] | None = None,
              location: str | None = None) -> dict[str, int]:
    """Load all tables as one version; returns the rows per table.

    ``check`` gets the stored tables and raises to stop the load. ``location`` is the folder
    of the schemas' tables where the session's warehouse folder is not wanted.
    """
    version = f"{schema}_load_{uuid.uuid4().hex[:12]}"

    def place(name: str) -> str:
        return f" location '{location.rstrip('/')}/{name}'" if location else ""

    spark.sql(f"create schema if not exists {schema}{place(schema)}")
    spark.sql(f"create schema {version}{place(version)}")
    try:
        counts = {}
        for name, df in tables.items():
            counted, counter = observed(df)
            counted.write.saveAsTable(f"{version}.{name}")
            counts[name] = counter.get["rows"]
        stored = {name: spark.table(f"{version}.{name}") for name in tables}
        if check is not None:
            check(stored)
        old = _pointers(spark, schema)
        before = old.get(CURRENT, "")
        spark.sql(f"alter schema {schema} set dbproperties "
                  f"('{PREVIOUS}' = '{before or version}', '{CURRENT}' = '{version}')")
    except BaseException:
        spark.sql(f"drop schema {version} cascade")
        raise
    for name in tables:
        spark.sql(f"create or replace view {schema}.{name} as select * from {version}.{name}")
    gone = old.get(PREVIOUS, "")
    if gone and gone not in (before, version):
        spark.sql(f"drop schema if exists {gone} cascade")
    return counts


def current_version(spark: SparkSession, schema: str = "analytics") -> str:
    """Name of the schema that holds the last finished load."""
    if not spark.catalog.databaseExists(schema):
        raise NotLoaded(schema)
    version = _pointers(spark, schema).get(CURRENT)
    if not version:
        raise NotLoaded(schema)
    return version


def read_star(spark: SparkSession, schema: str = "analytics") -> dict[str, DataFrame]:
    """All tables of the last finished load, of one version."""
    version = current_version(spark, schema)
    # a session's temporary views are listed under every schema
    return {t.name: spark.table(f"{version}.{t.name}")
            for t in spark.catalog.listTables(version) if not t.isTemporary}


def drop_star(spark: SparkSession, schema: str) -> None:
    """Remove the schema with its current and previous versions."""
    for version in set(_pointers(spark, schema).values()):
        spark.sql(f"drop schema if exists {version} cascade")
    spark.sql(f"drop schema {schema} cascade")
