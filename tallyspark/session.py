"""Session helpers: a local session for tests and the shared folder for durable intermediate data."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Settings worth giving a cluster session for facts of many terabytes; none changes a result.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    # Start wide and let adaptive execution merge what turns out small.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split skewed join partitions even if that costs a further shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.files.maxPartitionBytes": "256m",
    # Filters through joins that turn out small also prune the date partitions.
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
    # Checkpoints nobody refers to any more are deleted (set before the context starts).
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


# Folders of local sessions that named none.
_own: list[tempfile.TemporaryDirectory] = []


def local_session(
    cores: int | str = "*", app: str = "tallyspark", shuffle_partitions: int = 8, shared: str | None = None
) -> SparkSession:
    """A session for tests and benchmarks on one machine, with its folder for intermediate tables."""
    named = {"spark.checkpoint.dir": shared} if shared else {}
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config(map=named)
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where it is unset, a local-mode session, in which the machine is the cluster, gets a folder of its own that
    goes when the program ends; on a cluster that is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        _own.append(tempfile.TemporaryDirectory(prefix="tallyspark-", ignore_cleanup_errors=True))
        configured = _own[-1].name
    if not context.getCheckpointDir():
        context.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tallyspark-{uuid.uuid4().hex}/{name}"


def durable(df: DataFrame) -> DataFrame:
    """Compute a frame once and store it in the shared folder.

    For aggregated frames that a plan reads more than once: without it Catalyst may prune the
    readers differently and scan the fact again for each.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()
