"""Spark session settings the library relies on.

Only settings that are unset are filled in, so a cluster's own choices
(shuffle partitions, checkpoint folder, broadcast threshold) always win.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every query here assumes. AQE re-plans joins from runtime sizes
# (broadcast only what really is small, split skewed partitions, coalesce
# tiny ones); ANSI mode is what makes the NULLIF guards necessary.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "kartlens") -> SparkSession:
    """A local session for tests and the bench; a cluster passes its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("KARTLENS_DRIVER_MEMORY", "8g"))
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, creating a local one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is; without one a cluster session is refused, as executors could not
    read each other's files. The local fallback is for ``local`` masters.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="kartlens-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


# Fixed sizing targets for large inputs: bytes per scan split and per
# post-shuffle partition.
SPLIT_BYTES = 256 * 1024 * 1024


def sizing_for(input_bytes: int, total_cores: int) -> dict[str, str]:
    """Partition settings for an input of ``input_bytes`` on ``total_cores``:
    scan splits and shuffle partitions of about 256 MB (at least three waves
    of tasks), AQE coalescing toward the same size and splitting skewed join
    partitions above it."""
    partitions = max(3 * total_cores, -(-input_bytes // SPLIT_BYTES))
    return {
        "spark.sql.files.maxPartitionBytes": str(SPLIT_BYTES),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(SPLIT_BYTES),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(SPLIT_BYTES),
    }


# Spark's own defaults for the sized keys; a session value
# equal to these counts as not chosen by the user.
SPARK_DEFAULTS = {
    "spark.sql.files.maxPartitionBytes": ("134217728", "128m", "128MB"),
    "spark.sql.shuffle.partitions": ("200",),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": ("67108864", "64m", "64MB"),
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": ("268435456", "256m", "256MB"),
}


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files under ``path``, from the file system's own summary."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.getContentSummary(folder).getLength()


def apply_sizing(spark: SparkSession, input_bytes: int, total_cores: int) -> dict[str, str]:
    """Set the ``sizing_for`` values on keys still at Spark's default (a
    value the cluster chose is kept); returns what was applied."""
    applied = {}
    for key, value in sizing_for(input_bytes, total_cores).items():
        current = spark.conf.get(key, None)
        if current in (None, "") or current in SPARK_DEFAULTS.get(key, ()):
            spark.conf.set(key, value)
            applied[key] = value
    return applied
