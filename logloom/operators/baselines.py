"""Baseline parsers used for comparison.

* B23 — token LCS similarity `2*LCS/(m+n)`: an Arrow-batched pandas UDF, a bit
  for each token of one side.
* L1/L2 — the LCS leader parser: a line becomes a template when no earlier
  template reaches the threshold. Texts are compared through a similarity join
  (`lcs_pairs`), and the templates are found in rounds, all data sets at once:
  a text without an undecided earlier text near it leads, texts near a leader fall.
* L3 — the fixed-depth tree parser (He et al., 2017): lines are routed by
  (token count, first tokens with digits masked) — a native key — and each
  leaf keeps its groups in state, again in bounded micro-batches.
"""

from __future__ import annotations

import os
import re
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import DoubleType

from .. import config
from ..functions import text as T
from ..plans import lineage
from . import frame_ops


def _places(tokens: list) -> dict:
    places: dict = {}
    for k, x in enumerate(tokens):
        places[x] = places.get(x, 0) | 1 << k
    return places


def _lcs(tokens: list, places: dict, n: int) -> int:
    """A clear bit says that the LCS grows at this place of the other side."""
    full = row = (1 << n) - 1
    for x in tokens:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & full
    return n - row.bit_count()


def lcs_len(a: list, b: list) -> int:
    return _lcs(a, _places(b), len(b))


def lcs_sim(a: str, b: str) -> float:
    t1, t2 = a.split(), b.split()
    m, n = len(t1), len(t2)
    return 2.0 * lcs_len(t1, t2) / (m + n) if m + n > 0 else 0.0


@F.pandas_udf(DoubleType())
def lcs_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """B23 as a vectorised UDF over pairs of strings."""
    seen: dict = {}  # of this batch
    out = []
    for x, y in zip(a, b):
        x, y = (x or "").split(), y or ""
        if y not in seen:
            tokens = y.split()
            seen[y] = _places(tokens), len(tokens)
        places, n = seen[y]
        out.append(2.0 * _lcs(x, places, n) / (len(x) + n) if len(x) + n else 0.0)
    return pd.Series(out, dtype="float64")


def _run_keyed_stream(spark, lines: DataFrame, key: str, fn, out_schema: str, state_schema: str,
                      files: int = 8) -> DataFrame:
    from ..streaming.feed import ordered_feed

    def build(stream):
        return stream.groupBy(key).applyInPandasWithState(fn, out_schema, state_schema, "append",
                                                          GroupStateTimeout.NoTimeout)
    return ordered_feed(spark, lines, build, chunks=files, tag="baseline")


def _rare_first(texts: DataFrame, often: DataFrame, thr: float) -> DataFrame:
    """`dataset, id, n, token, nth`: of each text `(dataset, id, text)` the tokens of which
    a text with LCS similarity >= thr must share one, rarest first by `often`.

    The LCS takes no more than the tokens in common, counted with repeats. As
    2c/(m+n) >= thr and n >= c, a partner has at least c = thr*m/(2-thr) of m tokens, so
    one of the first m - c + 1 in any order that both sides keep.
    """
    tokens = texts.select("dataset", "id", F.explode(T.tokens("text")).alias("token"))
    counts = tokens.groupBy("dataset", "id", "token").agg(F.count(F.lit(1)).cast("int").alias("times"))
    item = F.struct(F.coalesce("often", F.lit(0)).alias("often"), "token", "times")
    each = (counts.join(often, ["dataset", "token"], "left").groupBy("dataset", "id")
            .agg(F.array_sort(F.collect_list(item)).alias("items"), F.sum("times").cast("int").alias("n")))  # one text's
    nth = F.flatten(F.transform("items", lambda x: F.transform(
        F.sequence(F.lit(1), x["times"]), lambda k: F.struct(x["token"].alias("token"), k.alias("nth")))))
    least = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(thr / (2.0 - thr)) - F.lit(1e-9)))
    return (each.select("dataset", "id", "n", F.explode(F.slice(nth, F.lit(1), (F.col("n") - least + 1).cast("int"))).alias("e"))
            .select("dataset", "id", "n", "e.*"))


def lcs_pairs(left: DataFrame, right: DataFrame, thr: float, earlier: bool = False) -> DataFrame:
    """Similarity join: `dataset, a, b, sim` of all pairs with LCS similarity >= thr > 0.

    `left`, `right`: `(dataset, id, text)`, ids unique in a data set. Pairs that share one of
    their rare tokens and agree in length are compared, no others; `earlier` keeps b < a
    only. Null texts and texts without tokens have no pairs.
    """
    if not 0.0 < thr <= 1.0:
        raise ValueError("thr must be above 0, up to 1")
    often = (right.select("dataset", "id", F.explode(F.array_distinct(T.tokens("text"))).alias("token"))
             .groupBy("dataset", "token").agg(F.count(F.lit(1)).alias("often")))
    p = _rare_first(left, often, thr).withColumnsRenamed({"id": "a", "n": "m"})
    q = _rare_first(right, often, thr).withColumnRenamed("id", "b")
    both = p.join(q, ["dataset", "token", "nth"]).where(2.0 * F.least("m", "n") / (F.col("m") + F.col("n")) >= thr)
    if earlier:
        both = both.where("b < a")
    met = (both.select("dataset", "a", "b").distinct()
           .join(left.select("dataset", F.col("id").alias("a"), F.col("text").alias("_a")), ["dataset", "a"])
           .join(right.select("dataset", F.col("id").alias("b"), F.col("text").alias("_b")), ["dataset", "b"]))
    return met.select("dataset", "a", "b", lcs_similarity("_a", "_b").alias("sim")).where(F.col("sim") >= thr)


def _leaders(texts: DataFrame, thr: float) -> DataFrame:
    """Texts `(dataset, id, text)` without an earlier leader (by id) of similarity >= thr.

    In each round the texts that no undecided earlier text is near to lead, and the
    texts near them fall; this is what going through them in order gives."""
    near = lineage.stored(lcs_pairs(texts, texts, thr, earlier=True).select("dataset", "a", "b"))
    out, open_ = texts.limit(0).select("dataset", "id"), texts.select("dataset", "id")
    while not near.isEmpty():
        lead = open_.join(near.select("dataset", F.col("a").alias("id")), ["dataset", "id"], "left_anti")
        fell = near.join(lead.withColumnRenamed("id", "b"), ["dataset", "b"], "left_semi").select("dataset", F.col("a").alias("id"))
        out = lineage.stored(out.unionByName(lead))
        open_ = lineage.stored(open_.join(out, ["dataset", "id"], "left_anti").join(fell, ["dataset", "id"], "left_anti"))
        for end in ("a", "b"):
            near = near.join(open_.withColumnRenamed("id", end), ["dataset", end], "left_semi")
        near = lineage.stored(near)
    return texts.join(out.unionByName(open_), ["dataset", "id"], "left_semi")


def lcs_parse(spark: SparkSession, lines: DataFrame, thr: float = config.LCS_THR, text: str = "normalised",
              first: int = 100, growth: int = 10) -> DataFrame:
    """L1: the LCS parser. Each line, in order of `line_id`, takes the first best of the
    templates there by then with similarity >= thr, else becomes a template itself (`is_new`).

    Distinct texts go in blocks of their order, each `growth` times the one before: what
    the templates so far match needs no more, only the rest is compared with itself.
    A line without tokens is new each time; null texts give a null template.
    """
    rows = lines.select("dataset", "line_id", F.col(text).alias("text"))
    texts = rows.where(F.size(T.tokens("text")) > 0).groupBy("dataset", "text").agg(F.min("line_id").alias("id"))
    texts = lineage.stored(frame_ops.positional_index(texts, ("dataset",), "id", "_pos"))
    last = texts.agg(F.max("_pos")).first()[0]
    led = texts.limit(0).select("dataset", "id", "text")
    low, size = 0, first
    while last is not None and low <= last:
        block = texts.where(F.col("_pos").between(low, low + size - 1)).select("dataset", "id", "text")
        if low:
            met = lcs_pairs(block, led, thr).select("dataset", F.col("a").alias("id"))
            block = lineage.stored(block.join(met, ["dataset", "id"], "left_anti"))
        led = lineage.stored(led.unionByName(_leaders(block, thr)))
        low, size = low + size, size * growth
    # Of a text's templates in order only those better than all before them are ever taken.
    before = W.partitionBy("dataset", "a").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    better = (lcs_pairs(texts.select("dataset", "id", "text"), led, thr)
              .withColumn("_best", F.max("sim").over(before)).where(F.col("_best").isNull() | (F.col("sim") > F.col("_best")))
              .join(led.select("dataset", F.col("id").alias("b"), F.col("text").alias("template")), ["dataset", "b"])
              .join(texts.select("dataset", F.col("id").alias("a"), "text"), ["dataset", "a"])
              .groupBy("dataset", "text").agg(F.array_sort(F.collect_list(F.struct("b", "template"))).alias("better")))  # rising sims of one text
    there = F.filter("better", lambda x: x["b"] <= F.col("line_id"))
    # The last one there is the best; a line that leads is its own template.
    took = F.element_at(there, -1)
    leads = F.when(F.col("better").isNull() | (F.size(there) == 0), True).otherwise(took["b"] == F.col("line_id"))
    return rows.join(better, ["dataset", "text"], "left").select(
        "dataset", "line_id", F.when(leads, F.col("text")).otherwise(took["template"]).alias("template"), leads.alias("is_new"))


def lcs_templates(spark: SparkSession, train: DataFrame, thr: float = config.LCS_THR, text: str = "normalised") -> DataFrame:
    """L2 train: the templates the leader pass creates, with their order."""
    p = lcs_parse(spark, train, thr, text)
    return p.where(F.col("is_new")).select("dataset", F.col("line_id").alias("t_ord"), "template")


def lcs_match(lines: DataFrame, tmpls: DataFrame, thr: float = config.LCS_THR, text: str = "normalised") -> DataFrame:
    """L2 match against frozen templates: first best (lowest `t_ord`, unique in a data set)
    with similarity >= thr, else unmatched (`template` null). Each distinct text is
    matched once (`lcs_pairs`)."""
    rows = lines.select("dataset", "line_id", F.col(text).alias("text"))
    texts = rows.where(F.col("text").isNotNull()).groupBy("dataset", "text").agg(F.min("line_id").alias("id"))
    t = tmpls.select("dataset", F.col("t_ord").alias("id"), F.col("template").alias("text"))
    best = (lcs_pairs(texts, t, thr).groupBy("dataset", F.col("a").alias("id"))
            .agg(F.max(F.struct("sim", (-F.col("b")).alias("_b"))).alias("best"))
            .select("dataset", "id", F.col("best.sim").alias("sim"), (-F.col("best._b")).alias("t_ord")))
    best = (best.join(tmpls.select("dataset", "t_ord", "template"), ["dataset", "t_ord"])
            .join(texts, ["dataset", "id"]).select("dataset", "text", "template", "sim"))
    return rows.join(best, ["dataset", "text"], "left").select("dataset", "line_id", "template", "sim")


# ------------------------------------------------------------------ tree parser

def tree_leaf(text, depth: int = 4) -> F.Column:
    """Route key: token count plus the first `depth - 2` tokens, digits masked."""
    toks = T.tokens(text)
    n = depth - 2
    head = F.transform(F.slice(toks, 1, n), lambda t: F.when(t.rlike(r"\d"), F.lit("<*>")).otherwise(t))
    return F.concat_ws("\u0001", F.size(toks).cast("string"), F.array_join(head, "\u0001"))


def tree_parse(spark: SparkSession, lines: DataFrame, sim_th: float = 0.5, depth: int = 4,
               text: str = "normalised") -> DataFrame:
    """L3: fixed-depth tree parser. Within a leaf, a line joins the group with
    the highest share of equal positions (>= sim_th; `<*>` positions count as
    equal-free), updating differing positions to `<*>`; else starts a group."""
    keyed = lines.select("dataset", "line_id", text).withColumn("leaf", F.concat_ws("\u0002", "dataset", tree_leaf(F.col(text), depth)))

    def fn(key, pdfs, state):
        groups = [g.split("\u0003") if g else [] for g in state.get[0]] if state.exists else []
        gids = list(state.get[1]) if state.exists else []
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values("line_id", kind="stable")
        out = []
        for ds, lid, s in zip(pdf["dataset"], pdf["line_id"], pdf[text]):
            lt = s.split()
            best, bi = -1.0, -1
            for i, g in enumerate(groups):
                if len(g) != len(lt) or not lt:
                    continue
                eq = sum(1 for a, b in zip(g, lt) if a == b)
                params = sum(1 for a in g if a == "<*>")
                sim = eq / len(lt)
                if sim > best or (sim == best and bi >= 0 and params > sum(1 for a in groups[bi] if a == "<*>")):
                    best, bi = sim, i
            if bi >= 0 and best >= sim_th:
                groups[bi] = [a if a == b else "<*>" for a, b in zip(groups[bi], lt)]
                out.append((ds, int(lid), gids[bi], " ".join(groups[bi]), False))
            else:
                groups.append(lt)
                gids.append(f"{key[0]}#{int(lid)}")
                out.append((ds, int(lid), gids[-1], s, True))
        state.update((["\u0003".join(g) for g in groups], gids))
        yield pd.DataFrame(out, columns=["dataset", "line_id", "group_id", "template", "is_new"])
    return _run_keyed_stream(spark, keyed, "leaf", fn,
                             "dataset string, line_id long, group_id string, template string, is_new boolean",
                             "groups array<string>, gids array<string>")


# ------------------------------------------------------------------ comparisons

def heldout_grouping(pred: DataFrame, gt: DataFrame, key: str = "line_id") -> DataFrame:
    """L4: unmatched lines get their own group `NEW::<line>`; truth ids default to
    `MISSING_<id>` (R7); returns rows ready for the GA metric."""
    p = pred.withColumn("pred_id", F.coalesce(F.col("template"), F.concat(F.lit("NEW::"), F.col("normalised"))))
    j = p.join(gt.select("dataset", key, "EventId"), ["dataset", key], "left")
    return j.withColumn("gt_id", F.coalesce(F.col("EventId"), F.concat(F.lit("MISSING_"), F.col(key).cast("string"))))


def match_rate(results: DataFrame, method: str, new_col: str = "is_new") -> DataFrame:
    """Per data set `1 - new/N` (learning run) and template count."""
    return results.groupBy("dataset").agg(
        F.lit(method).alias("method"), F.count(F.lit(1)).alias("n_logs"),
        (1.0 - F.avg(F.col(new_col).cast("double"))).alias("match_rate"),
        F.sum(F.col(new_col).cast("int")).alias("n_templates"))
