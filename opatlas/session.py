"""Session helpers: a local session for tests and the shared folder of the cluster."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(
    cores: int | str = "*", shuffle_partitions: int = 8, shared: str | None = None
) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own.

    ``shared`` is the folder for intermediate tables, where the session names none.
    """
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("opatlas")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        # No call sites for error messages: they double the cost of building a Column.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    if shared and not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(shared)
    return session


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if not context.getCheckpointDir():
        context.setCheckpointDir(configured)
    return configured.rstrip("/")


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read again.

    Survives the loss of executors, and readers take only the columns they need.
    """
    path = new_shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
