"""Dense numbers in a total order without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saleslode.session import cut_lineage


def dense_numbers(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """``df`` with numbers from 1 in the given order, which must tell all rows apart.

    Rows are dealt to partitions by range and stored, since ranges are sampled anew by every
    run; partitions are counted, one number each, and rows are numbered within theirs.
    """
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    starts, total = [], 0
    for row in ranged.groupBy("_part").count().orderBy("_part").collect():
        starts.append((row["_part"], total))
        total += row["count"]
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (ranged.withColumn("_local", local).join(F.broadcast(offsets), "_part")
            .withColumn(out, F.col("_start") + F.col("_local"))
            .drop("_part", "_local", "_start"))
