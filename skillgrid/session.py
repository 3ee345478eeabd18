"""Session settings and the shared working folder."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A join side is broadcast only when Spark's own size estimate (or AQE's measured size) is below this.
BROADCAST_BOUND = "32m"


def build_session(app: str = "skillgrid", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings the operators are tuned for. Deployment settings win over these."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.autoBroadcastJoinThreshold": BROADCAST_BOUND,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shuffle_width(spark: SparkSession) -> int:
    """Number of parallel slots to spread replicated or salted work over."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder for intermediate tables, sinks and stream checkpoints.

    It lies below ``spark.checkpoint.dir``, the folder every executor can reach. Only a local
    session without that setting falls back to a machine-local temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix=f"{label}-", dir=os.environ.get("TMPDIR", "/tmp"))


#: Spark then removes the shuffle files of an execution when it ends, not when the driver happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession):
    """What is written inside leaves no shuffle files. Only for results that are read back from where they were written."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Reliable checkpoints go to the configured folder; a local one is set only when none is."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(work_dir(spark, "checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """A small intermediate result kept in the checkpoint folder, so that it is computed once and survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(scan: DataFrame) -> DataFrame:
    """A plain file scan with at least one split per core; scans that have enough splits are left alone."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
