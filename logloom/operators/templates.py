"""Template extraction from clustered lines.

Input: one row per distinct line with `(dataset, cluster_id, normalised,
content, uniq_ord)`. Voting never gathers a cluster's lines in one place: it
explodes tokens by position and aggregates `(cluster, pos, token)` counts
(partial aggregation first), so a cluster with a billion lines costs as much
as its number of distinct (position, token) pairs. The only per-cluster
collection is the final template, whose length is bounded by the longest line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T

CL = ("dataset", "cluster_id")


def _sizes(clustered: DataFrame, keys=CL) -> DataFrame:
    return clustered.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_lines"))


def _apart(df: DataFrame, keys) -> DataFrame:
    """The rows as they are, no longer known to be dealt by `keys`. A union whose parts all seem to be is taken as
    dealt by them as a whole, which fails once a join inside one part is run as a broadcast."""
    return df.withColumn(keys[-1], T.once(keys[-1]))


def _assemble(pos_tokens: DataFrame, keys, tok_col: str, collapse_empty_to_wildcard=True) -> DataFrame:
    """Ordered tokens per cluster -> collapsed template string."""
    agg = pos_tokens.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("pos", tok_col))).alias("_pt"))
    toks = F.transform("_pt", lambda s: s[tok_col])
    tmpl = T.collapse_string(toks) if collapse_empty_to_wildcard else T.join_tokens(T.collapse(toks))
    return agg.select(*keys, tmpl.alias("template"))


def position_stats(clustered: DataFrame, keys=CL) -> DataFrame:
    """Per (cluster, position): all-token count and the best non-variable token.

    Best = most frequent non-variable token, ties to the first seen (lowest
    `uniq_ord`); null when the position holds only variable tokens. Variable tokens,
    nearly all distinct, are counted as one.
    """
    ex = clustered.select(*keys, "uniq_ord", F.posexplode(T.tokens("normalised")).alias("pos", "tok"))
    ex = ex.withColumn("tok", F.when(~T.is_variable(F.col("tok")), F.col("tok")))
    counts = (ex.groupBy(*keys, "pos", "tok")
              .agg(F.count(F.lit(1)).alias("cnt"), F.min("uniq_ord").alias("first_ord")))
    return counts.groupBy(*keys, "pos").agg(
        F.sum("cnt").alias("total"),
        F.max_by(F.struct("tok", "cnt"),
                 F.when(F.col("tok").isNotNull(), F.struct(F.col("cnt"), -F.col("first_ord")))).alias("best"))


def with_tau(df: DataFrame, tau, floor: float = config.VOTE_FLOOR):
    """Attach the voting threshold max(tau, floor) as column `_thr`.

    `tau` is a float, or a (dataset, tau) parameter frame (one row per system,
    broadcast), or a list of floats (a sweep: rows are replicated per value and
    `tau` becomes part of the key)."""
    if isinstance(tau, DataFrame):
        df = df.join(F.broadcast(tau.select("dataset", F.col("tau").alias("_tau"))), "dataset", "left")
        return df.withColumn("_thr", F.greatest(F.coalesce(F.col("_tau"), F.lit(config.DEFAULT_TAU)),
                                                F.lit(float(floor)))).drop("_tau")
    if isinstance(tau, (list, tuple)):
        grid = df.sparkSession.createDataFrame([(float(t),) for t in tau], "tau double")
        df = df.crossJoin(F.broadcast(grid))
        return df.withColumn("_thr", F.greatest(F.col("tau"), F.lit(float(floor))))
    return df.withColumn("_thr", F.greatest(F.lit(float(tau)), F.lit(float(floor))))


def vote_positions(clustered: DataFrame, tau, keys=CL, floor: float = config.VOTE_FLOOR) -> DataFrame:
    """Per (cluster, position) the voted token or `<*>`: the best token
    wins if its count / all tokens at the position >= max(tau, floor)."""
    per_pos = with_tau(position_stats(clustered, keys), tau, floor)
    voted = F.when(F.col("best.tok").isNull(), F.lit(T.WILDCARD)) \
        .when(F.col("best.cnt") / F.col("total") >= F.col("_thr"), F.col("best.tok")) \
        .otherwise(F.lit(T.WILDCARD))
    extra = ["tau"] if isinstance(tau, (list, tuple)) else []
    return per_pos.select(*keys, *extra, "pos", voted.alias("voted"))


def restore_prefixes(voted: DataFrame, clustered: DataFrame, keys=CL) -> DataFrame:
    """At a `<*>` position, if every raw token there that has an alphabetic
    prefix (>= 2 of `[A-Za-z_.]`) agrees on it, emit `prefix<*>`."""
    rx = (clustered.select(*keys, F.posexplode(T.tokens("content")).alias("pos", "rtok"))
          .select(*keys, "pos", T.raw_prefix(F.col("rtok")).alias("pfx"))
          .where(F.col("pfx") != ""))
    pf = rx.groupBy(*keys, "pos").agg(F.min("pfx").alias("pmin"), F.max("pfx").alias("pmax"))
    out = voted.join(pf, [*keys, "pos"], "left")
    tok = F.when((F.col("voted") == T.WILDCARD) & F.col("pmin").isNotNull() & (F.col("pmin") == F.col("pmax")),
                 F.concat(F.col("pmin"), F.lit(T.WILDCARD))).otherwise(F.col("voted"))
    extra = ["tau"] if "tau" in voted.columns else []
    return out.select(*keys, *extra, "pos", tok.alias("tok"))


def extract_templates(clustered: DataFrame, tau=0.5, keys=CL, prefixes: bool = True,
                      floor: float = config.VOTE_FLOOR) -> DataFrame:
    """One template per cluster — B20 for one-line clusters, else T1+T2+B11.

    Returns `(keys..., template, n_lines, store_ord)` where `store_ord` is the
    cluster's first-seen line (store row order).
    """
    sizes = clustered.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_lines"),
                                         F.min("uniq_ord").alias("store_ord"))
    with_n = clustered.join(sizes, list(keys))
    singles = (with_n.where(F.col("n_lines") == 1)
               .select(*keys, T.single_template(F.col("normalised"), F.col("content")).alias("template"),
                       "n_lines", "store_ord"))
    multi = with_n.where(F.col("n_lines") > 1)
    voted = vote_positions(multi, tau, keys, floor)
    sweep = isinstance(tau, (list, tuple))
    if sweep:
        singles = with_tau(singles, tau, floor).drop("_thr")
    toks = restore_prefixes(voted, multi, keys) if prefixes else voted.withColumnRenamed("voted", "tok")
    kk = [*keys, "tau"] if sweep else list(keys)
    many = _assemble(toks, kk, "tok").join(sizes, list(keys))
    return _apart(singles, keys).unionByName(many)


def extract_templates_no_prefix(clustered: DataFrame, tau=0.5, keys=CL,
                                floor: float = config.VOTE_FLOOR) -> DataFrame:
    """T4: ablation — no variable rule, share over cluster size, one line kept
    as is, no prefix restoration; an empty result stays empty."""
    sizes = clustered.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_lines"),
                                         F.min("uniq_ord").alias("store_ord"))
    with_n = clustered.join(sizes, list(keys))
    singles = with_n.where(F.col("n_lines") == 1).select(
        *keys, F.col("normalised").alias("template"), "n_lines", "store_ord")
    multi = with_n.where(F.col("n_lines") > 1)
    ex = multi.select(*keys, "uniq_ord", "n_lines", F.posexplode(T.tokens("normalised")).alias("pos", "tok"))
    counts = (ex.groupBy(*keys, "pos", "tok")
              .agg(F.count(F.lit(1)).alias("cnt"), F.min("uniq_ord").alias("first_ord"),
                   F.first("n_lines").alias("n_lines")))
    per_pos = counts.groupBy(*keys, "pos").agg(
        F.max_by(F.struct("tok", "cnt"), F.struct(F.col("cnt"), -F.col("first_ord"))).alias("best"),
        F.first("n_lines").alias("n_lines"))
    per_pos = with_tau(per_pos, tau, floor)
    tok = F.when(F.col("best.cnt") / F.col("n_lines") >= F.col("_thr"), F.col("best.tok")).otherwise(F.lit(T.WILDCARD))
    many = _assemble(per_pos.select(*keys, "pos", tok.alias("tok")), keys, "tok",
                     collapse_empty_to_wildcard=False).join(sizes, list(keys))
    return _apart(singles, keys).unionByName(many)


def attention_templates(rows: DataFrame, tau=0.5, variance_thr: float = 0.01, keys=CL) -> DataFrame:
    """T5: attention-variance templates for multi-line clusters.

    `rows`: `(keys..., uniq_ord, words ARRAY<STRING>, attention ARRAY<DOUBLE>)`
    where `attention[0]` belongs to the leading special token, so word `pos`
    has weight `attention[pos + 1]`. A position is `<*>` when the population
    variance of its weights exceeds `variance_thr` (or it has none); else the
    most common word if its share >= tau.
    """
    ex = rows.select(*keys, "uniq_ord", "attention", F.posexplode("words").alias("pos", "word"))
    ex = ex.withColumn("att", F.try_element_at("attention", F.col("pos") + 2))
    stats = ex.groupBy(*keys, "pos").agg(
        F.var_pop("att").alias("var"), F.count("att").alias("n_att"), F.count(F.lit(1)).alias("n_words"))
    wc = (ex.groupBy(*keys, "pos", "word")
          .agg(F.count(F.lit(1)).alias("cnt"), F.min("uniq_ord").alias("first_ord")))
    best = wc.groupBy(*keys, "pos").agg(
        F.max_by(F.struct("word", "cnt"), F.struct(F.col("cnt"), -F.col("first_ord"))).alias("best"))
    j = stats.join(best, [*keys, "pos"])
    variable = (F.col("n_att") == 0) | (F.col("var") > variance_thr)
    tok = (F.when(variable, F.lit(T.WILDCARD))
           .when(F.col("best.cnt") / F.col("n_words") >= F.lit(float(tau)), F.col("best.word"))
           .otherwise(F.lit(T.WILDCARD)))
    return _assemble(j.select(*keys, "pos", tok.alias("tok")), keys, "tok")
