"""Training-pair preparation for encoder fine-tuning (M1–M3).

Sampling is seeded and reproducible: orders come from `md5(seed|key)`, and
per-group positions from the distributed positional index, so no group is
ever sorted or gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from . import frame_ops


def _h(seed, *cols) -> F.Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols])), 1, 8), 16, 10).cast("long")


def positive_pairs(df: DataFrame, per_group: int = 10, cap: int = 200, seed: int = 42,
                   text: str = "content", group: str = "EventId") -> DataFrame:
    """M1: up to `per_group` sampled lines per truth group, consecutive pairs
    (label 1); the first `cap` pairs per data set (groups in first-seen order)."""
    w = W.partitionBy("dataset", group).orderBy(_h(seed, F.col("line_id")), "line_id")
    s = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_group)
    w2 = W.partitionBy("dataset", group).orderBy("_r")
    p = s.withColumn("text_b", F.lead(text).over(w2)).where(F.col("text_b").isNotNull())
    first = df.groupBy("dataset", group).agg(F.min("line_id").alias("_g"))
    p = p.join(first, ["dataset", group])
    w3 = W.partitionBy("dataset").orderBy("_g", "_r")
    return (p.withColumn("_k", F.row_number().over(w3)).where(F.col("_k") <= cap)
            .select("dataset", F.col(text).alias("text_a"), "text_b", F.lit(1).alias("label"), "_k"))


def negative_pairs(df: DataFrame, n_pos: DataFrame, cap: int = 200, seed: int = 42,
                   text: str = "content", group: str = "EventId") -> DataFrame:
    """M2: `min(#positive, cap)` draws of two different truth groups, one line
    from each (label 0). Draw i picks groups and lines by seeded hashes."""
    groups = df.select("dataset", group).distinct()
    gi = frame_ops.positional_index(groups, keys=("dataset",), order_col=group, name="gi")
    ng = groups.groupBy("dataset").agg(F.count(F.lit(1)).alias("E"))
    lines = frame_ops.positional_index(df.select("dataset", group, "line_id", text), keys=("dataset", group),
                                       order_col="line_id", name="li")
    gsize = df.groupBy("dataset", group).agg(F.count(F.lit(1)).alias("gn"))
    draws = (n_pos.join(ng, "dataset").where(F.col("E") >= 2)
             .withColumn("i", F.explode(F.sequence(F.lit(0), F.least(F.col("n_pos"), F.lit(cap)) - 1))))
    draws = (draws.withColumn("g1", F.pmod(_h(seed, F.col("dataset"), F.col("i"), F.lit("a")), F.col("E")))
             .withColumn("g2", F.pmod(F.col("g1") + 1 + F.pmod(_h(seed, F.col("dataset"), F.col("i"), F.lit("b")),
                                                               F.col("E") - 1), F.col("E"))))
    gmap = gi.join(gsize, ["dataset", group])
    a = gmap.select("dataset", F.col("gi").alias("g1"), F.col(group).alias("e1"), F.col("gn").alias("n1"))
    b = gmap.select("dataset", F.col("gi").alias("g2"), F.col(group).alias("e2"), F.col("gn").alias("n2"))
    d = draws.join(a, ["dataset", "g1"]).join(b, ["dataset", "g2"])
    d = (d.withColumn("l1", F.pmod(_h(seed, F.col("dataset"), F.col("i"), F.lit("c")), F.col("n1")))
         .withColumn("l2", F.pmod(_h(seed, F.col("dataset"), F.col("i"), F.lit("d")), F.col("n2"))))
    la = lines.select("dataset", F.col(group).alias("e1"), F.col("li").alias("l1"), F.col(text).alias("text_a"))
    lb = lines.select("dataset", F.col(group).alias("e2"), F.col("li").alias("l2"), F.col(text).alias("text_b"))
    return (d.join(la, ["dataset", "e1", "l1"]).join(lb, ["dataset", "e2", "l2"])
            .select("dataset", "text_a", "text_b", F.lit(0).alias("label"), F.col("i").alias("_k")))


def training_pairs(df: DataFrame, seed: int = 42, cap: int = 200) -> DataFrame:
    pos = positive_pairs(df, cap=cap, seed=seed)
    n_pos = pos.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_pos"))
    neg = negative_pairs(df, n_pos, cap=cap, seed=seed)
    return pos.unionByName(neg)


def pair_similarity(pairs: DataFrame, encoder=None, dim: int = 64) -> DataFrame:
    """M3: mean cosine (explicit norms) of the encoded pair texts, by label."""
    a = V.hashed_embedding(F.col("text_a"), dim) if encoder is None else encoder(F.col("text_a"))
    b = V.hashed_embedding(F.col("text_b"), dim) if encoder is None else encoder(F.col("text_b"))
    e = pairs.withColumn("ea", a).withColumn("eb", b)
    cos = T.dot("ea", "eb") / (V.l2norm("ea") * V.l2norm("eb"))
    return e.withColumn("sim", F.when((V.l2norm("ea") > 0) & (V.l2norm("eb") > 0), cos)) \
        .groupBy("dataset", "label").agg(F.avg("sim").alias("mean_sim"), F.count(F.lit(1)).alias("n_pairs"))
