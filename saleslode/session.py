"""Spark session defaults and reliable lineage cuts."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"

# Settings the plans are written for. Shuffles start wide and are merged at run time to
# partitions that fit an executor; skewed join partitions are split even where that
# costs one more shuffle, since one key may own a large share of all rows.
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def cluster_session(app: str = "saleslode") -> SparkSession:
    """Session on whatever master the launcher chose, with the settings above."""
    builder = SparkSession.builder.appName(app)
    for name, value in CLUSTER_SETTINGS.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def local_session(app: str = "saleslode", cores: str = "8", shuffle_partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """Session for tests and the local bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only on one machine, as in tests, may that setting be absent: a temporary folder is then
    chosen and remembered for the session. Elsewhere its absence is an error.
    """
    master = spark.sparkContext.master
    configured = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_SETTING
    )
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="saleslode-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, never used before."""
    return f"{shared_dir(spark).rstrip('/')}/saleslode/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def collect_garbage(spark: SparkSession) -> None:
    """Shuffle files of finished jobs go once the driver has collected its garbage.

    A driver with a large heap would keep those of all jobs so far on the executors' disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
