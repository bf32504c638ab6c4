"""Connected components of an undirected graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept

# Steps on few edges run in few tasks, however many partitions a shuffle has.
EDGES_A_TASK = 250_000


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root): ``root`` is the smallest node reachable from ``node``.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every step is a
    grouped minimum and a join, so no node's neighbours meet in one task. Nodes without an
    edge to another node are not listed. NULL ends, loops and repeated edges are ignored.
    """
    current = kept(edges.select(F.greatest(left, right).alias("u"),
                                F.least(left, right).alias("v"))
                   .where(F.col(left).isNotNull() & F.col(right).isNotNull()
                          & (F.col("u") != F.col("v"))).distinct())
    tasks = 1 + current.count() // EDGES_A_TASK
    mark = None
    while True:
        current = current.coalesce(tasks)
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (both.where("v > u").join(least, "u")
                 .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
                 .coalesce(tasks).distinct().coalesce(tasks))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(lowest, "u").where("v != m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        current = kept(small.unionByName(lowest.withColumnRenamed("m", "v")).coalesce(tasks)
                       .distinct().coalesce(tasks))
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    roots = current.select(F.col("v").alias("node")).distinct()
    return (current.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(roots.select("node", F.col("node").alias("root"))))
