"""Preprocessing, duplicate tagging, distinct lines, ordered split, sampling.

Row order is semantic in this domain (first-seen ties, the positional split),
so every frame carries `line_id`; nothing relies on physical row order.
Aggregations keyed by `(dataset, normalised)` use partial (map-side)
aggregation, so a line repeated a billion times costs one row per partition
before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T
from ..plans import lineage


def preprocess(df: DataFrame, log_format: str | None, regexes, line_col: str = "raw",
               keep_empty: bool = False) -> DataFrame:
    """B2 + B3 (+ A1's rule): add `content` and `normalised`.

    Rows whose content is empty are dropped (their `line_id` stays consumed),
    unless `keep_empty` (the online path keeps them).
    """
    out = df.withColumn("content", T.once(T.extract_content(F.col(line_col), log_format)))
    if not keep_empty:
        out = out.where(F.col("content") != "")
    return out.withColumn("normalised", T.once(T.mask(F.col("content"), regexes)))


def preprocess_preset(df: DataFrame, name: str, line_col: str = "raw", keep_empty=False) -> DataFrame:
    p = config.preset(name)
    return preprocess(df, p.log_format, p.regexes, line_col, keep_empty)


def non_blank(df: DataFrame, col: str = "normalised") -> DataFrame:
    """Drop null and empty values (literal `NA`/`null` text is kept)."""
    return df.where(F.col(col).isNotNull() & (F.col(col) != ""))


def distinct_lines(df: DataFrame, keys=("dataset",), col: str = "normalised",
                   content_col: str = "content") -> DataFrame:
    """DS2 + DS5: one row per distinct normalised line.

    `uniq_ord` = first line id (first-seen order), `content` = content of that
    first line, `freq` = number of lines. One partial+final aggregate; a content
    that masking left as it was is not shuffled beside the same normalised text.
    """
    other = F.when(~F.col(content_col).eqNullSafe(F.col(col)), F.struct(F.col(content_col).alias("c")))
    firsts = (non_blank(df, col).groupBy(*keys, col)
              .agg(F.min("line_id").alias("uniq_ord"),
                   F.min_by(other, "line_id").alias("_other"),
                   F.count(F.lit(1)).alias("freq")))
    content = F.when(F.col("_other").isNull(), F.col(col)).otherwise(F.col("_other.c"))
    return firsts.select(*keys, col, "uniq_ord", content.alias(content_col), "freq")


def tag_duplicates(df: DataFrame, keys=("dataset",), col: str = "normalised") -> DataFrame:
    """DS1: `is_duplicate` = an earlier line has the same normalised text.

    First ids come from a partially aggregated group-by joined back on the key;
    a hot key is split by AQE's skew-join handling instead of landing in one
    window partition.
    """
    firsts = df.groupBy(*keys, col).agg(F.min("line_id").alias("_first"))
    return (df.join(firsts, [*keys, col], "left")
            .withColumn("is_duplicate", F.coalesce(F.col("line_id") != F.col("_first"), F.lit(False)))
            .drop("_first"))


def positional_index(df: DataFrame, keys=("dataset",), order_col: str = "line_id",
                     name: str = "pos") -> DataFrame:
    """0-based position of each row within its key, ordered by `order_col`.

    Distributed, exact, and free of per-key windows: a range-partitioned sort,
    per-(partition, key) counts (a handful of rows), and prefix offsets joined
    back by broadcast. The sorted frame is checkpointed so the count job and
    the final job see the same partitioning.
    """
    spark = df.sparkSession
    keys = list(keys)
    tagged = (df.orderBy(*keys, order_col)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    tagged = lineage.cut(tagged)
    counts = (tagged.groupBy("_pid", *keys)
              .agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first_mid")))
    from pyspark.sql import Window as W
    w = W.partitionBy(*keys).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    # offsets has one row per (partition, key): bounded by partitions x keys.
    return (tagged.join(F.broadcast(offsets.select("_pid", *keys, "_off", "_first_mid")), ["_pid", *keys])
            .withColumn(name, F.col("_off") + F.col("_mid") - F.col("_first_mid"))
            .drop("_pid", "_mid", "_off", "_first_mid"))


def ordered_split(df: DataFrame, ratio: float = config.SPLIT_RATIO, keys=("dataset",)) -> DataFrame:
    """DS3: first `int(n * ratio)` rows (by line_id) are `offline`, the rest `online`."""
    indexed = positional_index(df, keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return (indexed.join(F.broadcast(sizes), list(keys))
            .withColumn("split", F.when(F.col("pos") < F.floor(F.col("_n") * F.lit(ratio)), "offline")
                        .otherwise("online"))
            .drop("_n"))


def select_mode(df: DataFrame, mode: str = "all") -> DataFrame:
    """DS4: `all` = offline ∪ online; `temporal` = offline only."""
    if mode == "all":
        return df
    if mode == "temporal":
        return df.where(F.col("split") == "offline")
    raise ValueError(f"unknown mode {mode!r}")


def split_summary(df: DataFrame, ratio: float = config.SPLIT_RATIO) -> DataFrame:
    """DS6: per data set totals and distinct offline lines (input carries `split`)."""
    return (df.groupBy("dataset")
            .agg(F.count(F.lit(1)).alias("total_logs"),
                 F.sum(F.when(F.col("split") == "offline", 1).otherwise(0)).alias("offline_logs"),
                 F.sum(F.when(F.col("split") == "online", 1).otherwise(0)).alias("online_logs"),
                 F.count_distinct(F.when(F.col("split") == "offline", F.col("normalised"))).alias("unique_offline"))
            .withColumn("split_ratio", F.lit(float(ratio))))


def seed_key(seed, key) -> F.Column:
    """Deterministic pseudo-random order shared with the SQL oracle: md5(seed || key)."""
    return F.md5(F.concat(F.lit(str(seed)), F.lit("|"), F.col(key).cast("string")))


def seeded_sample(df: DataFrame, n: int, seed: int = 42, key: str = "line_id",
                  keys=("dataset",)) -> DataFrame:
    """DS7: fixed-size reproducible sample per key (top-n by md5(seed|key)).

    `row_number() <= n` lets Catalyst insert a per-partition group limit before
    the shuffle, so each partition ships at most n rows per data set.
    """
    from pyspark.sql import Window as W
    w = W.partitionBy(*keys).orderBy(seed_key(seed, key), F.col(key))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
