"""Lineage cuts that survive executor loss.

Iterative and multi-pass operators cut their lineage with a reliable
`checkpoint()` into the shared folder named by `spark.checkpoint.dir` (read
from the session; the cluster sets it). Never `localCheckpoint()`: its blocks
live on executors and die with them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str | None:
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        spark.sparkContext.setCheckpointDir(conf)
        return spark.sparkContext.getCheckpointDir()
    return None


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint; raises if no shared checkpoint folder is configured."""
    if checkpoint_dir(df.sparkSession) is None:
        raise RuntimeError("spark.checkpoint.dir is not set: configure a shared folder "
                           "(tests call logloom.session.ensure_checkpoint_dir)")
    return df.checkpoint(eager=eager)


def stored(df: DataFrame) -> DataFrame:
    """`df` as Parquet in the shared checkpoint folder, read back. For loops that rename
    columns each round: a checkpointed plan keeps the optimizer's constraints, which
    double with every alias; a file scan has none."""
    spark = df.sparkSession
    base = checkpoint_dir(spark)
    if base is None:
        raise RuntimeError("spark.checkpoint.dir is not set: configure a shared folder")
    path = f"{base}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
