"""The flagship query (minimum slice, SURVEY §7.2) as a reusable plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T
from ..operators import frame_ops, templates
from ..sources import tables


def template_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_logs -> B2 -> B3 -> DS2 -> B9 as cluster -> T1+T2+T3 -> B13 -> line counts."""
    p = config.preset(tables.EVENT_PRESET)
    pp = frame_ops.preprocess(tables.event_logs(spark, sf_dir), p.log_format, p.regexes)
    uniq = frame_ops.distinct_lines(pp)
    cl = uniq.withColumn("cluster_id", T.partition_key(F.col("normalised"), F.col("dataset")))
    tm = templates.extract_templates(cl, p.tau)
    lines = cl.groupBy("dataset", "cluster_id").agg(F.sum("freq").alias("n_logs"))
    return (tm.join(lines, ["dataset", "cluster_id"])
            .select("dataset", "cluster_id", T.template_id("template").alias("template_id"), "template",
                    F.col("n_lines").alias("distinct_lines"), "n_logs", "store_ord"))
