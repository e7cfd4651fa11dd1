"""Batch entropy monitor (K2) without a per-data-set window.

Checkpoint c (every `interval` matched lines) looks at the last `window`
matched template buckets. Each row is sent to the few checkpoints whose window
contains it (at most window / interval of them), so the whole computation is
one exploded aggregate over a distributed positional index.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..operators import frame_ops
from ..plans import lineage


def entropy_checkpoints(matched: DataFrame, interval: int = config.ENTROPY["interval"],
                        window: int = config.ENTROPY["window"]) -> DataFrame:
    """`(dataset, line_id, template_id)` of matched lines -> per checkpoint the
    window size, normalised entropy and the threshold step (+1, -1, 0)."""
    e = config.ENTROPY
    idx = frame_ops.positional_index(matched.select("dataset", "line_id", "template_id"), keys=("dataset",),
                                     order_col="line_id", name="r")
    n = matched.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    r1 = F.col("r") + 1
    first = F.ceil(r1 / interval) * interval
    rows = (idx.join(F.broadcast(n), "dataset")
            .withColumn("bucket", F.pmod(F.conv("template_id", 16, 10).cast("long"), F.lit(e["buckets"])))
            .withColumn("c", F.explode(F.sequence(first.cast("long"), (r1 + window - 1).cast("long"),
                                                 F.lit(interval).cast("long"))))
            .where(F.col("c") <= F.col("n")))
    per = rows.groupBy("dataset", "c", "bucket").agg(F.count(F.lit(1)).alias("k"))
    tot = per.groupBy("dataset", "c").agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("distinct"))
    j = per.join(tot, ["dataset", "c"]).withColumn("p", F.col("k") / F.col("total"))
    ent = j.groupBy("dataset", "c").agg(F.sum(-F.col("p") * F.log2("p")).alias("h"),
                                        F.first("total").alias("n_window"), F.first("distinct").alias("n_buckets"))
    norm = F.when(F.col("n_buckets") > 1, F.col("h") / F.log2("n_buckets")).otherwise(F.lit(0.0))
    step = (F.when(F.col("n_window") < e["min_entries"], 0).when(F.col("_ne") > e["high"], 1)
            .when(F.col("_ne") < e["low"], -1).otherwise(0))
    return (ent.withColumn("_ne", norm)
            .select("dataset", F.col("c").alias("checkpoint"), "n_window",
                    F.round("_ne", 6).alias("norm_entropy"), step.alias("step")))


# ------------------------------------------------------------ running threshold

WIDTH = 256
CLAMP = "struct<s:double,lo:double,hi:double>"


def _clamped(x: Column, f: Column) -> Column:
    return F.least(f["hi"], F.greatest(f["lo"], x + f["s"]))


def _then(f: Column, g: Column) -> Column:
    """`g` after `f`: such steps compose to a step of the same shape."""
    return F.struct((f["s"] + g["s"]).alias("s"), _clamped(f["lo"], g).alias("lo"), _clamped(f["hi"], g).alias("hi"))


def _scan(steps: DataFrame, start: Column, levels: int) -> DataFrame:
    """`dataset, i, x`: the value after step i. steps: `dataset, i, f`, i from 0 without gaps.

    Chunks of `WIDTH` steps are composed, their values come from a scan over the chunks
    (`levels` deep), and each chunk then runs through its own steps."""
    chunk = F.floor(F.col("i") / WIDTH)
    chunks = steps.groupBy("dataset", chunk.alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("i", "f"))).alias("fs"))  # at most WIDTH
    if levels == 0:
        chunks = chunks.withColumn("x", start)
    else:
        same = F.struct(F.lit(0.0).alias("s"), F.lit(-math.inf).alias("lo"), F.lit(math.inf).alias("hi"))
        whole = chunks.select("dataset", F.col("chunk").alias("i"), F.aggregate("fs", same, lambda a, b: _then(a, b["f"])).alias("f"))
        after = _scan(whole, start, levels - 1).select("dataset", (F.col("i") + 1).alias("chunk"), "x")
        chunks = chunks.join(after, ["dataset", "chunk"], "left").withColumn("x", F.coalesce("x", start))
    none = F.struct(F.col("x").alias("x"), F.array().cast("array<struct<i:bigint,x:double>>").alias("out"))

    def step(a: Column, b: Column) -> Column:
        x = _clamped(a["x"], b["f"])
        return F.struct(x.alias("x"), F.concat(a["out"], F.array(F.struct(b["i"].alias("i"), x.alias("x")))).alias("out"))

    run = F.explode(F.aggregate("fs", none, step, lambda a: a["out"])).alias("o")
    return chunks.select("dataset", run).select("dataset", "o.i", "o.x")


def running_threshold(checkpoints: DataFrame, interval: int = config.ENTROPY["interval"], base: float = config.ENTROPY["base"],
                      step: float = config.ENTROPY["step"], low: float = config.ENTROPY["min_t"],
                      high: float = config.ENTROPY["max_t"]) -> DataFrame:
    """K2: `dataset, checkpoint, threshold`, the clamped threshold after each checkpoint of `entropy_checkpoints`.

    A step takes x to min(high, max(low, x + s)). Steps of this shape compose, so the walk
    is a prefix scan in a few rounds of bounded groups, whatever the length of a stream.
    A null step leaves the threshold as it is; no rows give none."""
    s = F.coalesce(F.col("step"), F.lit(0)).cast("double") * step
    f = F.struct(s.alias("s"), F.lit(float(low)).alias("lo"), F.lit(float(high)).alias("hi"))
    steps = checkpoints.select("dataset", (F.col("checkpoint") / interval - 1).cast("long").alias("i"), f.alias("f"))
    if lineage.checkpoint_dir(steps.sparkSession):  # the entropies are worked out once, not once a level
        steps = lineage.cut(steps)
    last = steps.agg(F.max("i")).first()[0] or 0
    levels = 0
    while last >= WIDTH:
        last, levels = last // WIDTH, levels + 1
    out = _scan(steps, F.lit(float(base)), levels)
    return out.select("dataset", ((F.col("i") + 1) * interval).alias("checkpoint"), F.round("x", 6).alias("threshold"))
