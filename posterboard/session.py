"""A session with the settings that the plans are written for."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def get_session(name: str = "posterboard", master: str | None = None) -> SparkSession:
    """UTC, adaptive execution with skew handling; sizes are left to the cluster's own settings."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    builder = builder.config("spark.sql.execution.arrow.pyspark.enabled", "true")
    builder = builder.config("spark.sql.python.filterPushdown.enabled", "true")  # for sources.base.live_table
    return (builder.master(master) if master else builder).getOrCreate()


def ensure_checkpoints(spark: SparkSession) -> None:
    """Sets a folder for checkpoints only where the session has none, as in tests; a cluster names its own shared one in spark.checkpoint.dir."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
