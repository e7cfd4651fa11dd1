"""Readers and writers over paths that the caller gives.

All are plain DataFrame readers and writers, so any file system that Spark
reads will do, and columns and filters are pushed down where the format can.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..operators import store as store_ops

SPLIT = "line_id long, raw string, content string, normalised string, is_duplicate boolean"
TRUTH = "LineId long, Content string, EventId string, EventTemplate string"
STORE = ("template_id string, template string, centroid array<float>, occurrences long, first_seen string, "
         "last_seen string, source string, dataset string")


def raw_lines(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """A1: `dataset, line_id, raw` of text files; line ids count from 1 in the order of
    files and lines, blank lines included. Undecodable bytes go.

    Files follow each other by name, and a file's splits by where they begin. A task reads
    a split from its first line to its last, so a line's place in its split is its row
    number less that of the split's first line; splits add the lines of all before them
    (a row for each split is summed up, not one for each line). Both readings are scans of
    one plan, with the same splits; no line leaves the JVM or is shuffled by its text."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = spark.read.text(path).select("value", at.alias("split"), F.monotonically_increasing_id().alias("row"))
    splits = lines.groupBy("split").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.orderBy("split").rowsBetween(W.unboundedPreceding, -1))
    splits = splits.select("split", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))
    return lines.join(splits, "split").select(
        F.lit(dataset).alias("dataset"), (F.col("row") + F.col("shift")).alias("line_id"),
        F.replace(F.make_valid_utf8("value"), F.lit("�"), F.lit("")).alias("raw"))


def non_blank_lines(spark: SparkSession, path: str) -> DataFrame:
    """A2: `line_id, raw` of the lines that hold more than blanks, stripped; ids count all lines."""
    rows = raw_lines(spark, path, "").select("line_id", text.strip(F.col("raw")).alias("raw"))
    return rows.where(F.col("raw") != "")


def write_split(lines: DataFrame, path: str) -> None:
    """Lines with a `split`, by data set and split, and beside them the summary."""
    from ..operators import frame_ops
    names = ["dataset", "split", *(c.split()[0] for c in SPLIT.split(", "))]
    lines.select(*names).write.partitionBy("dataset", "split").mode("overwrite").parquet(f"{path}/lines")
    frame_ops.split_summary(lines).write.mode("overwrite").json(f"{path}/summary")


def read_split(spark: SparkSession, path: str, mode: str = "all") -> DataFrame:
    """A3, DS4: what `write_split` wrote; `temporal` reads the offline files only."""
    from ..operators import frame_ops
    return frame_ops.select_mode(spark.read.parquet(f"{path}/lines"), mode)


def read_split_csv(spark: SparkSession, offline: str, online: str | None = None) -> DataFrame:
    """A3: CSV files of both parts, with a header."""
    def read(path, name):
        return spark.read.csv(path, header=True, schema=SPLIT, multiLine=True, escape='"').withColumn("split", F.lit(name))
    out = read(offline, "offline")
    return out.unionByName(read(online, "online")) if online else out


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """A4: CSV with a header; other columns are ignored, rows without an event go."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    typed = [F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in TRUTH.split(", ")]
    return rows.select(*typed).where(F.col("EventId").isNotNull())


def write_store(store: DataFrame, path: str, form: str = "parquet") -> None:
    """Parquet or JSON, with the order of entries."""
    store.write.mode("overwrite").format(form).save(path)


def read_store(spark: SparkSession, path: str, form: str = "parquet", dedupe: str = "keep_all") -> DataFrame:
    """A5: what `write_store` wrote; `last` keeps the last row of a repeated template id."""
    reader = spark.read.format(form)
    if form == "json":
        reader = reader.schema(f"{STORE}, store_ord long")
    return store_ops.dedupe(reader.load(path), dedupe)


def write_results(results: DataFrame, path: str, summary: DataFrame | None = None, form: str = "csv") -> None:
    """A line for each result (CSV with a header, or JSON), and a summary beside them."""
    writer = results.write.mode("overwrite")
    (writer.option("header", True).csv if form == "csv" else writer.json)(f"{path}/results")
    if summary is not None:
        summary.write.mode("overwrite").json(f"{path}/summary")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A10: CSV with six decimals, and JSON as they are."""
    shown = [F.format_string("%.6f", F.col(n)).alias(n) if t == "double" else F.col(n) for n, t in metrics.dtypes]
    metrics.select(*shown).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    metrics.write.mode("overwrite").json(f"{path}/json")
