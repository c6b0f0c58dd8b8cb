"""Session settings for jobs, tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "incidentlab", master: str | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """Session with adaptive execution, skew-join handling and a UTC clock.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the submit
    command names the master, and adaptive execution sizes the partitions.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "64m")  # by measured shuffle sizes
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and hand-over tables.

    The cluster names it in ``spark.checkpoint.dir``. A private temporary
    folder is used only for a local master with that setting unset (tests).
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="incidentlab-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def new_table_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for one hand-over table."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
