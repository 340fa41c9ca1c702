"""Spark session and shared-storage helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str = "local[8]", partitions: int = 8, app: str = "hotspot") -> SparkSession:
    """Session used by tests and the bench; a cluster job brings its own session."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Shared folder for materialised tables and checkpoints.

    On a cluster this is ``spark.checkpoint.dir`` as configured for the session, and a job
    without it is refused: a folder of the driver's own disk is none of the executors'. Only a
    local session (tests) has a fresh local folder made and registered instead.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if not d:
        d = sc.getConf().get("spark.checkpoint.dir", None)
        if not d and (sc.master.startswith("local-cluster") or not sc.master.startswith("local")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not d:
            d = tempfile.mkdtemp(prefix="hotspot-")
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    return d


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused location below the shared folder."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (written to the shared folder, survives executor loss)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """Written once as a table in the shared folder and read back: computed one time, and not again
    when an executor is lost."""
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
