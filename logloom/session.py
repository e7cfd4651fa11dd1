"""Session helpers for tests, the bench and local runs.

Library code never creates sessions; it takes the caller's. These helpers
only fill in settings that are unset (a cluster's own settings win).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.driver.memory": "16g",
    "spark.sql.execution.pythonUDF.arrow.enabled": "true",
    # small local inputs: keep post-shuffle partitions parallel for CPU-heavy
    # stages (encoding, clustering) instead of coalescing them into one task
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.ui.showConsoleProgress": "false",
}


def ensure_checkpoint_dir(spark: SparkSession, base: str | None = None) -> str:
    """Use `spark.checkpoint.dir` when the session names one; otherwise (tests,
    local runs) create a fresh scratch folder for this session."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        conf = tempfile.mkdtemp(prefix="logloom-ckpt-", dir=base or "/tmp")
        spark.conf.set("spark.checkpoint.dir", conf)
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir()


def local_session(cores: str | int = "*", app: str = "logloom", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in {**LOCAL_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark
