"""Agglomerative clustering of distinct lines inside partitions.

Plan shape
----------
1. Lines are grouped by `(dataset, partition key)` (B9); each group's cut
   thresholds are computed natively from its `dist`.
2. A group at most `cap` lines long is clustered in one `applyInPandas` call
   with a numpy nearest-neighbour-chain (average or complete linkage), which
   returns the labels for **every** candidate cut in one pass.
3. In a larger group equal vectors first become one weighted point (they merge at
   height 0 in any case), and the points are split — exactly — into connected
   components of the graph `distance < largest cut`: average/complete linkage never merges
   across such components below that height, so clustering components apart
   gives the same partitions. Edges come from block pairs (each emits only a
   spanning forest, so edge volume stays linear per block pair), components
   from iterative min-label propagation with reliable checkpoints.
4. Cut quality (E4/E5) needs whole-group cluster sizes, so it is a native
   two-level aggregate over `(group, cut)`; the best cut per group is a
   `max_by` (first cut wins ties).

5. A component still above `cap` becomes a table of merge heights
   (`dendrogram`), from which every cut is read; a sweep over distances clusters
   once and joins all its cuts. Exact cluster counts come from that table, too, at
   any size. No row is cut off.

Equal heights are told apart by a hash of the two clusters' ids in both ways of
clustering, so `cap` decides where the work is done, not what comes out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..plans import lineage
from . import dendrogram as D
from .kernels import DEFAULT_CAP, cut_labels, forest_edges, nn_chain

GROUP = ("dataset", "pkey")


# ------------------------------------------------------------ grouped steps

_CUT_SCHEMA = "gid string, uniq_ord long, cut int, thr double, label long"


def _cluster_group_fn(linkage: str):
    """A group's lines, or its points with weights, at every cut."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uniq_ord", kind="stable")
        ords = pdf["uniq_ord"].to_numpy()
        sizes = pdf["weight"].to_numpy() if "weight" in pdf else None
        merges = nn_chain(np.vstack(pdf["embedding"].to_numpy()), linkage, ords, sizes)
        return pd.concat([pd.DataFrame({"gid": pdf["gid"].iloc[0], "uniq_ord": ords, "cut": ci, "thr": float(thr),
                                        "label": ords[cut_labels(len(ords), merges, threshold=float(thr))]})
                          for ci, thr in enumerate(pdf["thrs"].iloc[0])], ignore_index=True)
    return fn


def _forest_fn():
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        eps = float(pdf["eps"].iloc[0])
        a = pdf[pdf["side"] == 0]
        b = pdf[pdf["side"] == 1]
        xa = np.vstack(a["embedding"].to_numpy()) if len(a) else np.zeros((0, 1))
        oa = a["uniq_ord"].to_numpy()
        if len(b) == 0:
            e = forest_edges(xa, None, eps) if len(a) > 1 else []
            ids = oa
        else:
            xb = np.vstack(b["embedding"].to_numpy())
            e = forest_edges(xa, xb, eps) if len(a) else []
            ids = np.concatenate([oa, b["uniq_ord"].to_numpy()])
        gid = pdf["gid"].iloc[0]
        return pd.DataFrame({"gid": gid, "u": [int(ids[i]) for i, _ in e],
                             "v": [int(ids[j]) for _, j in e]}, columns=["gid", "u", "v"])
    return fn


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components of `(gid, u, v)` edges; returns `(gid, uniq_ord, comp)`
    with `comp` = smallest vertex id of the component.

    Each round takes the minimum label over neighbours and then jumps pointers
    (label <- label of label), which needs O(log diameter) rounds on long
    chains instead of O(diameter). Labels are checkpointed every round so
    lineage stays short and a lost executor costs one round.
    """
    und = edges.select("gid", "u", "v").unionByName(
        edges.select("gid", F.col("v").alias("u"), F.col("u").alias("v")))
    und = lineage.cut(und)
    labels = lineage.cut(vertices.select("gid", "uniq_ord", F.col("uniq_ord").alias("comp")))
    while True:  # labels only fall, so this ends
        nb = (und.join(labels.withColumnRenamed("uniq_ord", "v").withColumnRenamed("comp", "lv"), ["gid", "v"])
              .groupBy("gid", "u").agg(F.min("lv").alias("m")))
        step = (labels.join(nb.withColumnRenamed("u", "uniq_ord"), ["gid", "uniq_ord"], "left")
                .select("gid", "uniq_ord", F.least("comp", F.coalesce("m", "comp")).alias("comp")))
        # a component label must also be lowered where its root was lowered
        via = step.join(step.select("gid", F.col("uniq_ord").alias("comp"), F.col("comp").alias("jump")),
                        ["gid", "comp"], "left")
        new = via.select("gid", "uniq_ord", F.least("comp", F.coalesce("jump", "comp")).alias("comp"))
        new = lineage.cut(new)
        changed = new.join(labels.withColumnRenamed("comp", "old"), ["gid", "uniq_ord"]) \
            .where(F.col("comp") != F.col("old")).limit(1).count()
        labels = new
        if changed == 0:
            return labels


def split_components(big: DataFrame, eps_col: str = "eps", block: int = 8000) -> DataFrame:
    """E10 (exact part): `(gid, uniq_ord, embedding, eps, ...)` -> adds `comp`.

    Lines are hashed into ceil(n / block) blocks per group; each block pair
    is one task that emits a spanning forest of its `distance < eps` edges.
    """
    sizes = big.groupBy("gid").agg(F.count(F.lit(1)).alias("n"))
    t = big.join(sizes, "gid") \
        .withColumn("nb", F.ceil(F.col("n") / F.lit(block)).cast("int")) \
        .withColumn("blk", F.pmod(F.xxhash64("uniq_ord"), F.col("nb")).cast("int"))
    rep = t.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rep = rep.select("gid", "uniq_ord", "embedding", F.col(eps_col).alias("eps"),
                     F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"),
                     F.when((F.col("blk") == F.least("blk", "other")), 0).otherwise(1).alias("side"))
    # as one key: rows that the join dealt by group would otherwise stay together
    edges = rep.groupBy(F.struct("gid", "bi", "bj").alias("cell")).applyInPandas(_forest_fn(), "gid string, u long, v long")
    comps = connected_components(big.select("gid", "uniq_ord"), edges)
    return big.join(comps, ["gid", "uniq_ord"])


# ------------------------------------------------------------ thresholds

def _clamp(c):
    lo, hi = config.CUT_CLAMP
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def thresholds(method: str, dist: F.Column) -> F.Column:
    if method == "two_stage":
        return F.array(*[_clamp(dist * f) for f in config.CUT_FACTORS])
    if method == "single_stage":
        return F.array(*[_clamp(dist * f) for f in config.SINGLE_STAGE_FACTORS])
    if method == "adaptive":
        b = dist
        return F.array_sort(F.array_distinct(F.array(
            F.greatest(F.lit(0.06), b * 0.5), F.greatest(F.lit(0.08), b * 0.7),
            F.greatest(F.lit(0.10), b * 0.85), b, F.least(F.lit(0.5), b * 1.12))))
    raise ValueError(method)


# ------------------------------------------------------------ main entry

def _with_dist(df: DataFrame, dist) -> DataFrame:
    if isinstance(dist, DataFrame):
        return df.join(F.broadcast(dist.select("dataset", F.col("dist").alias("_dist"))), "dataset", "left") \
            .withColumn("_dist", F.coalesce("_dist", F.lit(config.DEFAULT_DIST)))
    return df.withColumn("_dist", F.lit(float(dist)))


def _with_k(df: DataFrame, n_clusters) -> tuple[DataFrame, bool, bool]:
    """Adds `_k` (0: cut by distance); tells whether some data sets, and whether all, may be of exact size."""
    if isinstance(n_clusters, DataFrame):
        k = n_clusters.select("dataset", F.col("n_clusters").cast("long").alias("_k")).where("_k > 0")
        if k.limit(1).count() == 0:
            return df.withColumn("_k", F.lit(0).cast("long")), False, False
        return df.join(F.broadcast(k), "dataset", "left").withColumn("_k", F.coalesce("_k", F.lit(0).cast("long"))), True, False
    k = n_clusters or 0
    return df.withColumn("_k", F.lit(max(k, 0)).cast("long")), k > 0, k > 0


def _component_cuts(points: DataFrame, linkage: str, cap: int, block: int) -> DataFrame:
    """`_group_cuts` of groups above `cap` points, `(gid, uniq_ord, embedding, weight, thrs, eps)`, by components."""
    fn = _cluster_group_fn(linkage)
    comps = split_components(points, block=block)
    csize = comps.groupBy("gid", "comp").agg(F.count(F.lit(1)).alias("c_n"))
    comp_in = lineage.cut(comps.join(csize, ["gid", "comp"])
                          .withColumn("gid", F.concat_ws("\u0002", "gid", F.col("comp").cast("string")))
                          .select("gid", "uniq_ord", "embedding", "weight", "thrs", "eps", "c_n"))
    part = comp_in.where(F.col("c_n") <= cap).drop("c_n", "eps").groupBy("gid").applyInPandas(fn, _CUT_SCHEMA)
    over = comp_in.where(F.col("c_n") > cap).drop("c_n")
    if over.limit(1).count() > 0:
        part = part.unionByName(D.labels_at(over, D.merge_rounds(over.drop("thrs"), linkage, cap)))
    return part.withColumn("gid", F.substring_index("gid", "\u0002", 1))


def _group_cuts(lines: DataFrame, linkage: str, cap: int, block: int) -> DataFrame:
    """Labels of `(gid, uniq_ord, embedding, thrs, g_n)` at every cut, as `_CUT_SCHEMA`, each group clustered once."""
    # singletons never need a Python worker
    cuts = lines.where(F.col("g_n") == 1).select(
        "gid", "uniq_ord", F.posexplode("thrs").alias("cut", "thr"), F.col("uniq_ord").alias("label"))
    fn = _cluster_group_fn(linkage)
    multi = lines.where(F.col("g_n") > 1).select("gid", "uniq_ord", "embedding", "thrs", "g_n")
    cuts = cuts.unionByName(multi.where(F.col("g_n") <= cap).drop("g_n").groupBy("gid").applyInPandas(fn, _CUT_SCHEMA))
    big = multi.where(F.col("g_n") > cap).drop("g_n")
    if big.limit(1).count() > 0:
        points, of = D.points(big.withColumn("eps", F.array_max("thrs")))
        points = points.join(points.groupBy("gid").agg(F.count(F.lit(1)).alias("g_n")), "gid")
        part = points.where(F.col("g_n") <= cap).select("gid", "uniq_ord", "embedding", "weight", "thrs").groupBy("gid").applyInPandas(fn, _CUT_SCHEMA)
        large = points.where(F.col("g_n") > cap).drop("g_n")
        if large.limit(1).count() > 0:
            part = part.unionByName(_component_cuts(large, linkage, cap, block))
        part = part.withColumnRenamed("uniq_ord", "point")
        cuts = cuts.unionByName(of.join(part, ["gid", "point"]).drop("point"))
    return cuts


def _grouped(df: DataFrame, cols) -> DataFrame:
    df = df.withColumn("gid", F.concat_ws("\u0001", *[F.col(c).cast("string") for c in cols]))
    return df.join(df.groupBy("gid").agg(F.count(F.lit(1)).alias("g_n"), F.sum("freq").alias("g_freq")), "gid")


def _named(df: DataFrame, cols) -> DataFrame:
    return df.withColumn("cluster_id", F.concat_ws("#", *[F.col(c).cast("string") for c in cols], F.col("label").cast("string"))) \
        .drop("gid", "thrs", "_dist", "_k", "g_n", "g_freq", "label")


def cluster_lines(lines: DataFrame, dist=0.7, method: str = "two_stage", score: str = "default",
                  linkage: str = "average", cap: int = DEFAULT_CAP, group_cols=GROUP,
                  n_clusters: int | DataFrame | None = None, block: int = 8000) -> DataFrame:
    """Cluster distinct lines within groups and pick the best cut per group.

    `lines`: `(dataset, [pkey], uniq_ord, embedding[, freq])`. `dist` is a
    float or a `(dataset, dist)` parameter frame. `method`: `two_stage` (E3,
    E5 with score='frequency', E7 with a fixed dist), `single_stage` (E6),
    `adaptive` (E8). `n_clusters`, a number or a `(dataset, n_clusters)` frame,
    switches a data set to exactly so many clusters over all its lines (E2),
    whatever their keys and `dist`; null or 0 leaves it to the cuts.
    Returns the input with `cluster_id` (string) and `cut_thr` (null for E2).
    """
    values = cluster_sweep(lines, [dist], method, score, linkage, cap, group_cols, n_clusters, block)
    return values.drop("value_no")


def cluster_sweep(lines: DataFrame, dists: list, method: str = "two_stage", score: str = "default",
                  linkage: str = "average", cap: int = DEFAULT_CAP, group_cols=GROUP,
                  n_clusters: int | DataFrame | None = None, block: int = 8000) -> DataFrame:
    """`cluster_lines` for several values of `dist`, every group clustered once for the cuts
    of all of them; adds `value_no`, the place of the value in `dists`."""
    df = lines if "freq" in lines.columns else lines.withColumn("freq", F.lit(1).cast("long"))
    df, some, every = _with_k(df, n_clusters)
    out = None
    if not every:
        g = df.where(F.col("_k") == 0)
        for i, d in enumerate(dists):
            g = _with_dist(g, d).withColumn(f"_thrs{i}", thresholds(method, F.col("_dist"))).drop("_dist")
        # encoded once for all that follows
        g = lineage.cut(_grouped(g, group_cols).withColumn("thrs", F.array_sort(F.array_distinct(F.flatten(F.array(
            *[F.col(f"_thrs{i}") for i in range(len(dists))]))))))
        cuts = lineage.cut(_group_cuts(g, linkage, cap, block))
        for i in range(len(dists)):
            mine = g.select("gid", f"_thrs{i}").groupBy("gid").agg(F.first(f"_thrs{i}").alias("own"))
            own = cuts.drop("cut").join(mine.select("gid", F.posexplode("own").alias("cut", "thr")), ["gid", "thr"])
            chosen = choose_cut(own, g.select("gid", "uniq_ord", "freq", "g_n", "g_freq"), method, score)
            one = _named(g.drop(*[f"_thrs{k}" for k in range(len(dists))]).join(chosen, ["gid", "uniq_ord"]), list(group_cols))
            one = one.withColumn("value_no", F.lit(i))
            out = one if out is None else out.unionByName(one)
    if some:
        g = lineage.cut(_grouped(df.where(F.col("_k") > 0), ["dataset"]))
        lab = D.labels_exact(g.select("gid", "uniq_ord", F.col("_k").alias("k")), D.dendrogram(g, linkage, cap))
        exact = _named(g.join(lab, ["gid", "uniq_ord"]), ["dataset"]).withColumn("cut_thr", F.lit(None).cast("double"))
        exact = exact.withColumn("value_no", F.explode(F.array(*[F.lit(i) for i in range(len(dists))])))
        out = exact if out is None else out.unionByName(exact)
    return out


def cut_scores(cuts: DataFrame, lines: DataFrame, score: str = "default") -> DataFrame:
    """E4/E5 per (group, cut): `log1p(k) - 2*singleton share - 5*largest share`
    (- 3 * frequency share of singleton clusters), -1000 if largest > 60%."""
    j = cuts.join(lines, ["gid", "uniq_ord"])
    cl = j.groupBy("gid", "cut", "label").agg(F.count(F.lit(1)).alias("sz"), F.sum("freq").alias("fq"),
                                              F.first("g_n").alias("g_n"), F.first("g_freq").alias("g_freq"),
                                              F.first("thr").alias("thr"))
    per = cl.groupBy("gid", "cut").agg(
        F.count(F.lit(1)).alias("k"), F.max("sz").alias("mx"),
        F.sum(F.when(F.col("sz") == 1, 1).otherwise(0)).alias("n_single"),
        F.sum(F.when(F.col("sz") == 1, F.col("fq")).otherwise(0)).alias("f_single"),
        F.first("g_n").alias("g_n"), F.first("g_freq").alias("g_freq"), F.first("thr").alias("thr"))
    max_frac = F.col("mx") / F.col("g_n")
    base = F.log1p(F.col("k")) - 2.0 * F.col("n_single") / F.col("k") - 5.0 * max_frac
    if score == "frequency":
        base = base - 3.0 * F.col("f_single") / F.col("g_freq")
    return per.withColumn("max_frac", max_frac).withColumn(
        "score", F.when(max_frac > 0.6, F.lit(-1000.0)).otherwise(base))


def choose_cut(cuts: DataFrame, lines: DataFrame, method: str, score: str) -> DataFrame:
    sc = cut_scores(cuts, lines, score)
    if method == "single_stage":
        valid = sc.where(F.col("max_frac") <= 0.6)
        best = valid.groupBy("gid").agg(F.max_by("cut", F.struct("score", -F.col("cut"))).alias("best"))
        picked = cuts.join(best, "gid", "left")
        # no valid cut (or one line): one cluster for the whole group
        grp_min = cuts.groupBy("gid").agg(F.min("uniq_ord").alias("_gmin"))
        picked = picked.join(grp_min, "gid").where(
            F.col("best").isNull() & (F.col("cut") == 0) | (F.col("cut") == F.col("best")))
        return picked.select("gid", "uniq_ord", F.col("thr").alias("cut_thr"),
                             F.when(F.col("best").isNull(), F.col("_gmin")).otherwise(F.col("label")).alias("label"))
    if method == "adaptive":
        agg = sc.groupBy("gid").agg(
            F.max("score").alias("ms"),
            F.max_by("cut", F.struct("score", -F.col("cut"))).alias("by_score"),
            F.max_by("cut", F.struct("k", -F.col("cut"))).alias("by_k"))
        best = agg.select("gid", F.when(F.col("ms") <= -999, F.col("by_k")).otherwise(F.col("by_score")).alias("best"))
    else:
        best = sc.groupBy("gid").agg(F.max_by("cut", F.struct("score", -F.col("cut"))).alias("best"))
    return cuts.join(best, "gid").where(F.col("cut") == F.col("best")) \
        .select("gid", "uniq_ord", F.col("thr").alias("cut_thr"), "label")


def assign_partition_keys(lines: DataFrame, keyword_stage: bool = True) -> DataFrame:
    """B9 as the stage-1 grouping, or one group per data set (no keyword stage)."""
    from ..functions import text as T
    if keyword_stage:
        return lines.withColumn("pkey", T.partition_key(F.col("normalised"), F.col("dataset")))
    return lines.withColumn("pkey", F.lit(""))
