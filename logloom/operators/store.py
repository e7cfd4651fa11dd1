"""Template store as an ordinary table keyed by `dataset`.

Schema: `dataset, template_id, template, centroid ARRAY<FLOAT>, occurrences,
first_seen, last_seen, source, store_ord`. One table holds every system's
store; every operator is keyed by `dataset` and never mixes systems.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T
from ..functions import vectors as V
from . import cluster as C
from ..plans import lineage
from ..streaming.learner import greedy_merge
from . import frame_ops, templates

STORE_COLS = ["dataset", "template_id", "template", "centroid", "occurrences",
              "first_seen", "last_seen", "source", "store_ord"]


def centroids(df: DataFrame, keys, vec: str = "embedding", eps: float = 1e-8) -> DataFrame:
    """G1: per key, mean vector divided by (norm + eps).

    `Summarizer.mean` is a JVM aggregate with partial (map-side) aggregation,
    so a cluster of any size costs one buffer per partition.
    """
    m = (df.withColumn("_v", array_to_vector(F.col(vec)))
         .groupBy(*keys).agg(Summarizer.mean(F.col("_v")).alias("_m")))
    arr = vector_to_array(F.col("_m"), dtype="float64")
    return m.select(*keys, V.normalize(arr, eps).alias("centroid"))


def build_store(lines: DataFrame, params: DataFrame | None = None, *, dist=None, tau=None,
                n_clusters=None, variant: str = "default", score: str = "default",
                encoder=None, dim: int = 64, cap: int = C.DEFAULT_CAP, as_of=None,
                embedded: DataFrame | None = None, cache_path: str | None = None,
                encoder_name: str = "hashed") -> DataFrame:
    """G2 (+G8 variants): preprocessed lines -> store rows, all data sets at once.

    `lines`: `(dataset, line_id, content, normalised)`. Per-system parameters
    come from `params` `(dataset, dist, tau, n_clusters)` or the scalar
    overrides; a system with `n_clusters` is clustered to exactly that many, without
    keyword groups and whatever its `dist`. Variants: `default`, `fixed_distance` (dist 0.5 everywhere),
    `no_keyword` (single-stage clustering), `no_prefix` (T4 voting).
    Rows come out with `store_ord` = first line of the cluster. With `cache_path`, vectors
    are taken from and added to the table there, under `encoder_name` (`kept_encode`).
    """
    uniq = frame_ops.distinct_lines(lines)
    emb = embedded
    if emb is None and cache_path is not None:
        emb = V.kept_encode(uniq, cache_path, encoder_name, encoder=encoder, dim=dim)
    elif emb is None:
        emb = V.encode_lines(uniq, encoder=encoder, dim=dim)
    emb = C.assign_partition_keys(emb, keyword_stage=(variant != "no_keyword"))
    d = params if dist is None else float(dist)
    if variant == "fixed_distance":
        d = 0.5
    if d is None:
        d = config.DEFAULT_DIST
    method = "single_stage" if variant == "no_keyword" else "two_stage"
    k = n_clusters
    if k is None and params is not None and "n_clusters" in params.columns:
        k = params
    clustered = C.cluster_lines(emb, dist=d, method=method, score=score, cap=cap, n_clusters=k)
    # chosen once, then read by the sizes, votes, prefixes and centroids
    clustered = lineage.stored(clustered.select("dataset", "cluster_id", "normalised", "content", "uniq_ord", "embedding"))
    t = params if tau is None else float(tau)
    if t is None:
        t = config.DEFAULT_TAU
    keys = ("dataset", "cluster_id")
    if variant == "no_prefix":
        tm = templates.extract_templates_no_prefix(clustered, t, keys)
    else:
        tm = templates.extract_templates(clustered, t, keys)
    cents = centroids(clustered, list(keys))
    now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    return (tm.join(cents, list(keys))
            .select("dataset", T.template_id("template").alias("template_id"), "template", "centroid",
                    F.col("n_lines").cast("long").alias("occurrences"),
                    now.alias("first_seen"), now.alias("last_seen"),
                    F.lit("parser").alias("source"), "store_ord", "cluster_id"))


def build_summary(lines: DataFrame, store: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """Per data set — logs, distinct lines, templates, threshold, tau."""
    non_null = lines.where(F.col("normalised").isNotNull() & (F.col("normalised") != ""))
    s = (lines.groupBy("dataset").agg(F.count(F.lit(1)).alias("total_logs"))
         .join(non_null.groupBy("dataset").agg(F.count_distinct("normalised").alias("unique_logs")), "dataset")
         .join(store.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_templates")), "dataset"))
    if params is not None:
        s = s.join(F.broadcast(params.select("dataset", F.col("dist").alias("threshold"),
                                             F.col("tau").alias("tau_r"))), "dataset", "left")
    return s


def dedupe(store: DataFrame, how: str = "keep_all") -> DataFrame:
    """`keep_all` rows, or `last` row per template id (store order)."""
    if how == "keep_all":
        return store
    last = store.groupBy("dataset", "template_id").agg(F.max("store_ord").alias("store_ord"))
    return store.join(last, ["dataset", "template_id", "store_ord"], "left_semi")


def index_columns(store: DataFrame) -> DataFrame:
    """Fixed tokens, first fixed keyword (store class), first token (scorers)."""
    return (store.withColumn("fixed_tokens", T.fixed_tokens("template"))
            .withColumn("first_fixed_kw", T.first_fixed_keyword("template"))
            .withColumn("first_tok", T.first_token("template")))


def keyword_lookup(store: DataFrame, keywords: DataFrame) -> DataFrame:
    """Templates whose first fixed token equals a (lower-cased) keyword."""
    s = index_columns(store)
    q = keywords.select("dataset", F.lower("keyword").alias("first_fixed_kw"))
    return s.join(q, ["dataset", "first_fixed_kw"])


_STEP_COLS = ("dataset", "template_id", "line_id", "n", "vector")
_FOLDED = "dataset string, template_id string, centroid array<float>"


def _fold(batches):
    """Centroids of templates whose rows (STEP_COLS, the first one the start) follow each
    other; holds one centroid at a time, whatever the number of rows."""
    key, seen, at = None, 0.0, None

    def out(rows):
        sets, ids, vectors = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(sets, pa.string()), pa.array(ids, pa.string()), pa.array(vectors, pa.list_(pa.float32()))],
            ["dataset", "template_id", "centroid"])

    for b in batches:
        done = []
        sets, ids, counts = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("dataset", "template_id", "n"))
        vectors = b.column(b.schema.get_field_index("vector"))
        for k, n, v in zip(zip(sets, ids, strict=True), counts, vectors, strict=True):
            v = v.values.to_numpy(zero_copy_only=False)
            if k != key:
                if key is not None:
                    done.append((*key, at.astype(np.float32)))
                key, seen, at = k, float(n), v.copy()
                continue
            seen += n
            alpha = 1.0 / (seen + 1.0)
            u = alpha * v + (1.0 - alpha) * at
            at = u / (np.sqrt(u @ u) + 1e-8)
        if done:
            yield out(done)
    if key is not None:
        yield out([(*key, at.astype(np.float32))])


def folded_centroids(starts: DataFrame, steps: DataFrame) -> DataFrame:
    """Ordered centroid fold (G3, G4): `dataset, template_id, centroid`.

    `starts` and `steps`: STEP_COLS, `n` the occurrences a row brings. A template begins
    with its row in `starts`, or else with its first step; each further step adds `n`, then
    blends with alpha = 1/(occurrences + 1) and renormalises (+1e-8). Steps go in order of
    `line_id`, equal ones by `n` and vector. The order is the definition, so a template's
    rows are read by one task, but as a sorted stream that Spark spills: nothing is
    gathered. Null vectors are no steps.
    """
    def part(df, later):
        return df.select("dataset", "template_id", F.lit(later).alias("_later"), F.col("line_id").cast("long").alias("line_id"),
                         F.col("n").cast("double").alias("n"), F.col("vector").cast("array<double>").alias("vector"))
    rows = part(starts, 0).unionByName(part(steps, 1)).where(F.col("vector").isNotNull())
    # By a hash of its own: a shuffle by the plain keys is left out where both inputs seem to have
    # that partitioning, which no longer holds once a join below is run as a broadcast.
    rows = (rows.repartition(F.xxhash64("dataset", "template_id"))
            .sortWithinPartitions("dataset", "template_id", "_later", "line_id", "n", "vector"))
    return rows.select(*_STEP_COLS).mapInArrow(_fold, _FOLDED)


def _starts(store: DataFrame, touched: DataFrame) -> DataFrame:
    return (store.join(touched, ["dataset", "template_id"], "left_semi")
            .select("dataset", "template_id", F.lit(0).alias("line_id"), F.col("occurrences").alias("n"),
                    F.col("centroid").alias("vector")))


def apply_hits(store: DataFrame, hits: DataFrame, as_of=None) -> DataFrame:
    """G4 batch form: fold ordered hits `(dataset, template_id, line_id, vector)`
    into the store. Each hit adds 1 to `occurrences` first, then blends with
    alpha = 1/(occurrences + 1) (`folded_centroids`). Counts are partial sums. Hits of
    templates that the store lacks are left out."""
    now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    counts = hits.groupBy("dataset", "template_id").agg(F.count(F.lit(1)).alias("_n"))
    steps = (hits.withColumn("n", F.lit(1)).join(store.select("dataset", "template_id"), ["dataset", "template_id"], "left_semi"))
    moved = folded_centroids(_starts(store, counts), steps).withColumnRenamed("centroid", "_c")
    j = store.join(counts, ["dataset", "template_id"], "left").join(moved, ["dataset", "template_id"], "left")
    return j.select(
        "dataset", "template_id", "template",
        F.coalesce("_c", F.col("centroid").cast("array<float>")).alias("centroid"),
        (F.col("occurrences") + F.coalesce("_n", F.lit(0))).cast("long").alias("occurrences"), "first_seen",
        F.when(F.col("_n").isNotNull(), now).otherwise(F.col("last_seen")).alias("last_seen"),
        "source", "store_ord")


def upsert(store: DataFrame, delta: DataFrame, as_of=None) -> DataFrame:
    """Add templates `(dataset, template, centroid, count, source, line_id)`.

    Same id -> occurrences += count, last_seen refreshed, centroid blended with
    alpha = 1/(occurrences + 1) (after the increment); else a new row, which starts
    from its first delta row. Several delta rows for one id fold in `line_id` order
    (`folded_centroids`); counts and first rows are partial aggregates.
    """
    now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    d = delta.withColumn("template_id", T.template_id("template"))
    row = F.struct("line_id", F.col("count").alias("cnt"), F.col("centroid").alias("vector"), "template", "source")
    g = d.groupBy("dataset", "template_id").agg(F.sum("count").alias("_n"), F.min(row).alias("_first"))
    steps = d.select("dataset", "template_id", "line_id", F.col("count").alias("n"), F.col("centroid").alias("vector"))
    moved = folded_centroids(_starts(store, g), steps).withColumnRenamed("centroid", "_c")
    j = (store.join(g, ["dataset", "template_id"], "full_outer")
         .join(moved, ["dataset", "template_id"], "left"))
    first = F.col("_first")
    max_ord = store.agg(F.max("store_ord")).collect()[0][0] or 0  # one scalar
    return j.select(
        "dataset", "template_id",
        F.coalesce("template", first["template"]).alias("template"),
        F.coalesce("_c", F.col("centroid").cast("array<float>")).alias("centroid"),
        (F.coalesce("occurrences", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("long").alias("occurrences"),
        F.coalesce("first_seen", now).alias("first_seen"),
        F.when(first.isNotNull(), now).otherwise(F.col("last_seen")).alias("last_seen"),
        F.coalesce("source", first["source"]).alias("source"),
        F.coalesce("store_ord", F.lit(max_ord) + first["line_id"]).alias("store_ord"))


PAIR_BLOCK, LARGEST_PAIR_BLOCK = 2000, 65536
PAIRS_AT_ONCE = 1 << 23  # likenesses that a task holds


def _pairs_fn(thr: float, names: list[str]):
    """Two blocks of rows, or one with itself -> their pairs. Matrix products name the pairs, some rows
    at a time; their cosines are then summed in the order of the components, as `T.dot` does."""
    def block(t: pa.Table):
        ords = t["ord"].to_numpy()
        by = np.argsort(ords, kind="stable")
        c = t["c"].combine_chunks()
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        return ords[by], t["id"].take(pa.array(by)), c.flatten().to_numpy(zero_copy_only=False).reshape(len(ords), -1)[by].astype(np.float64)

    def fn(t: pa.Table) -> pa.Table:
        second = t["second"].to_numpy()
        alone = t["bi"][0] == t["bj"][0]
        oa, ia, xa = block(t.filter(pa.array(~second)))
        ob, ib, xb = (oa, ia, xa) if alone else block(t.filter(pa.array(second)))
        out, step = [], max(1, PAIRS_AT_ONCE // max(1, len(ob)))
        for at in range(0, len(oa), step):
            skip = at if alone else 0  # in order, so what comes before has met these rows
            i, j = np.nonzero(~(xa[at:at + step] @ xb[skip:].T < thr - 1e-6 * max(1.0, abs(thr))))  # with what is no number
            i, j = i + at, j + skip
            meet = oa[i] < ob[j] if alone else oa[i] != ob[j]
            i, j = i[meet], j[meet]
            sim = np.zeros(len(i))
            for d in range(xa.shape[1]):
                sim += xa[i, d] * xb[j, d]
            kept = (sim >= thr) | np.isnan(sim)  # a number that is none is the greatest in Spark's order
            out.append((i[kept], j[kept], sim[kept]))
        i, j, sim = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        first = oa[i] < ob[j]
        ids = [pa.chunked_array([*ia.chunks, *ib.chunks], type=ia.type).take(pa.array(x))
               for x in (np.where(first, i, j + len(oa)), np.where(first, j + len(oa), i))]
        return pa.table([pa.repeat(t["dataset"][0], len(i)), *ids, np.where(first, oa[i], ob[j]), np.where(first, ob[j], oa[i]), sim],
                        names=names).cast(pa.schema([(n, t[c].type if c else k) for n, c, k in zip(
                            names, ("dataset", "id", "id", None, None, None), (None, None, None, pa.int64(), pa.int64(), pa.float64()), strict=True)]))
    return fn


def compaction_pairs(store: DataFrame, thr: float = config.COMPACT_SIM) -> DataFrame:
    """G6 step 1: template pairs of one data set with cosine >= thr (i before j).

    Blocks of rows meet as matrices, one pair of blocks a task: all pairs are compared, and a task holds
    two blocks and its own hits, whatever the size of the store. A row is copied for every block, so there are
    no more of these than the tasks ask for, unless they came to above `LARGEST_PAIR_BLOCK` rows."""
    # what has no cosine with anything: null vectors and components; lengths that differ never meet
    rows = store.where(F.col("dataset").isNotNull() & F.col("store_ord").isNotNull() & F.col("centroid").isNotNull()
                       & ~F.coalesce(F.exists("centroid", lambda x: x.isNull()), F.lit(False)))
    types = dict(store.select("template_id", "store_ord", "centroid").dtypes)
    ids, ords = types["template_id"], types["store_ord"]
    vector = "array<float>" if types["centroid"] == "array<float>" else "array<double>"
    rows = rows.select("dataset", F.col("template_id").alias("id"), F.col("store_ord").cast("long").alias("ord"),
                       F.col("centroid").cast(vector).alias("c"), F.size("centroid").alias("dim"))
    enough = math.ceil(math.sqrt(2 * int(store.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))))
    n = F.count(F.lit(1))
    sizes = rows.groupBy("dataset", "dim").agg(F.greatest(F.ceil(n / LARGEST_PAIR_BLOCK), F.least(F.ceil(n / PAIR_BLOCK), F.lit(enough))).cast("int").alias("nb"))
    # two rows meet in the one cell of their two blocks; rows are dealt by their order
    dealt = rows.join(sizes, ["dataset", "dim"]).withColumn("blk", F.pmod(F.xxhash64("ord", "id"), F.col("nb")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    cells = dealt.select("dataset", "dim", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"),
                         (F.col("blk") > F.col("other")).alias("second"), "id", "ord", "c")
    # as one key: rows that a join dealt by data set would otherwise be grouped where they are, all in one task
    found = cells.groupBy(F.struct("dataset", "dim", "bi", "bj").alias("cell")).applyInArrow(
        _pairs_fn(thr, ["dataset", "id_i", "id_j", "ord_i", "ord_j", "sim"]), f"dataset string, id_i {ids}, id_j {ids}, ord_i long, ord_j long, sim double")
    return found.select("dataset", "id_i", "id_j", F.col("ord_i").cast(ords).alias("ord_i"), F.col("ord_j").cast(ords).alias("ord_j"), "sim")


_COMPACT_SCHEMA = ("dataset string, template_id string, occurrences long, centroid array<float>, removed boolean")


def _greedy_compact(thr: float):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("store_ord", kind="stable").reset_index(drop=True)
        occ, cents, removed = greedy_merge(np.stack(pdf["centroid"].to_list()), pdf["occurrences"], thr)
        return pd.DataFrame({"dataset": pdf["dataset"], "template_id": pdf["template_id"],
                             "occurrences": occ, "centroid": [c.tolist() for c in cents],
                             "removed": removed})
    return fn


def compact(store: DataFrame, capacity: int = config.STORE_CAPACITY, thr: float = config.COMPACT_SIM) -> DataFrame:
    """For data sets above `capacity`, greedily merge pairs with cosine >= thr
    (larger `occurrences` survives, ties to the earlier entry; counts add,
    centroid blended). Only entries that take part in some pair go through a
    Python worker, grouped by connected component of the pair graph."""
    sizes = store.groupBy("dataset").agg(F.count(F.lit(1)).alias("_n"))
    over = store.join(sizes.where(F.col("_n") > capacity).select("dataset"), "dataset", "left_semi")
    pairs = lineage.stored(compaction_pairs(over, thr))  # read by each of the steps below
    edges = pairs.select(F.col("dataset").alias("gid"), F.col("ord_i").alias("u"), F.col("ord_j").alias("v"))
    verts = over.select(F.col("dataset").alias("gid"), F.col("store_ord").alias("uniq_ord"))
    involved = edges.select("gid", F.col("u").alias("uniq_ord")).unionByName(
        edges.select("gid", F.col("v").alias("uniq_ord"))).distinct()
    comps = C.connected_components(involved, edges)
    members = (over.join(comps.select(F.col("gid").alias("dataset"), F.col("uniq_ord").alias("store_ord"), "comp"),
                         ["dataset", "store_ord"]))
    merged = members.groupBy("dataset", "comp").applyInPandas(
        lambda pdf: _greedy_compact(thr)(pdf), _COMPACT_SCHEMA)
    upd = merged.where(~F.col("removed")).drop("removed")
    gone = merged.where(F.col("removed")).select("dataset", "template_id")
    kept = store.join(gone, ["dataset", "template_id"], "left_anti")
    return (kept.join(upd.withColumnRenamed("occurrences", "_o").withColumnRenamed("centroid", "_c"),
                      ["dataset", "template_id"], "left")
            .withColumn("occurrences", F.coalesce("_o", "occurrences"))
            .withColumn("centroid", F.coalesce("_c", "centroid"))
            .drop("_o", "_c"))
