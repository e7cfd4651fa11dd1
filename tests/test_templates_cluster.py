import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.operators import cluster as C
from logloom.operators import dendrogram as D
from logloom.operators import kernels as K
from logloom.operators import templates


def _clustered(spark, rows):
    return spark.createDataFrame(
        [("d", "c", n, r, i) for i, (n, r) in enumerate(rows)],
        "dataset string, cluster_id string, normalised string, content string, uniq_ord long")


def test_vote(spark):
    t = templates.extract_templates(_clustered(spark, [("a b c", "a b c"), ("a b d", "a b d"), ("a b e", "a b e")]), 0.10)
    assert t.collect()[0]["template"] == "a b <*>"


def test_prefix_restoration(spark):
    rows = [("got <*> now", "got blk_1 now"), ("got <*> later", "got blk_2 later")]
    t = templates.extract_templates(_clustered(spark, rows), 0.90)
    assert t.collect()[0]["template"] == "got blk_<*> <*>"


def _naive_average(x, thr):
    """Brute-force average linkage: merge the closest pair while its distance < thr."""
    cl = [[i] for i in range(len(x))]
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    while len(cl) > 1:
        best = None
        for a, b in itertools.combinations(range(len(cl)), 2):
            v = d[np.ix_(cl[a], cl[b])].mean()
            if best is None or v < best[0]:
                best = (v, a, b)
        if best[0] >= thr:
            break
        _, a, b = best
        cl[a] = cl[a] + cl[b]
        del cl[b]
    return sorted(sorted(c) for c in cl)


def test_nn_chain_matches_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(25):
        n = rng.integers(2, 14)
        x = rng.normal(size=(n, 4))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        merges = C.nn_chain(x)
        for thr in (0.3, 0.7, 1.0, 1.4):
            lab = C.cut_labels(n, merges, threshold=thr)
            got = sorted(sorted(np.flatnonzero(lab == r).tolist()) for r in set(lab.tolist()))
            assert got == _naive_average(x, thr)


def test_cut_score_formula(spark):
    # sizes 2,1,1 of 4: ln 4 - 2*(2/3) - 5*0.5
    cuts = spark.createDataFrame([("g", i, 0, 0.5, lab) for i, lab in enumerate([0, 0, 2, 3])],
                                 "gid string, uniq_ord long, cut int, thr double, label long")
    lines = spark.createDataFrame([("g", i, 1, 4, 4) for i in range(4)],
                                  "gid string, uniq_ord long, freq long, g_n long, g_freq long")
    s = C.cut_scores(cuts, lines).collect()[0]["score"]
    assert abs(s - (math.log(4) - 2 * (2 / 3) - 5 * 0.5)) < 1e-9


def test_component_split_equals_whole_group(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(4, 8))
    pts = np.vstack([c + 0.05 * rng.normal(size=(12, 8)) for c in centers])
    pts /= np.linalg.norm(pts, axis=1, keepdims=True)
    rows = [("d", "k", i, [float(v) for v in p]) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "dataset string, pkey string, uniq_ord long, embedding array<double>")
    whole = C.cluster_lines(df, dist=0.5, cap=1000).select("uniq_ord", "cluster_id")
    split = C.cluster_lines(df, dist=0.5, cap=20, block=10).select("uniq_ord", "cluster_id")

    def parts(d):
        g = {}
        for r in d.collect():
            g.setdefault(r["cluster_id"], set()).add(r["uniq_ord"])
        return sorted(sorted(v) for v in g.values())
    assert parts(whole) == parts(split)


def test_component_above_cap_is_clustered_whole(spark):
    # one chain of 12 equal distances: the order of equal heights matters, too
    rows = [("d", "k", i, [i / 10]) for i in range(12)]
    df = spark.createDataFrame(rows, "dataset string, pkey string, uniq_ord long, embedding array<double>")
    whole, rounds = ({r["uniq_ord"]: (r["cluster_id"], r["cut_thr"]) for r in
                      C.cluster_lines(df, dist=0.3, cap=cap).collect()} for cap in (1000, 4))
    assert len(rounds) == 12 and rounds == whole


def _points(pts, eps=None):
    rows = [("g", i, [float(v) for v in p]) + (() if eps is None else (eps,)) for i, p in enumerate(pts)]
    return rows, "gid string, uniq_ord long, embedding array<double>" + ("" if eps is None else ", eps double")


def _merges(df):
    return sorted((r["gid"], r["height"], r["size"], r["parent"], r["child"]) for r in df.collect())


@pytest.mark.parametrize("linkage,block", [("average", 20)])
def test_rounds_give_the_cuts_of_one_chain(spark, linkage, block):
    # many equal distances, since coordinates are multiples of 0.1
    pts = np.unique(np.random.default_rng(7).integers(0, 4, size=(40, 3)), axis=0) / 10
    thrs = (0.11, 0.15, 0.2)
    df = spark.createDataFrame(*_points(pts, max(thrs)))
    report = []
    merges = D.dendrogram(df, linkage, cap=4, block=block, report=report)
    at = df.withColumn("thrs", F.array(*map(F.lit, thrs)))
    got = {(r["cut"], r["uniq_ord"]): r["label"] for r in D.labels_at(at, merges).collect()}
    chain = C.nn_chain(pts, linkage)
    assert got == {(c, i): int(x) for c, t in enumerate(thrs) for i, x in enumerate(C.cut_labels(len(pts), chain, threshold=t))}
    assert report[0]["looking"] == len(pts) and all(r["looking"] <= r["clusters"] for r in report)
    assert [r["clusters"] for r in report] == sorted((r["clusters"] for r in report), reverse=True)
    assert report[-1]["block_pairs"] < report[0]["block_pairs"]


def test_equal_lines_above_cap_are_one_point(spark, monkeypatch):
    # 120 lines on 12 places: rounds and components see places, not lines
    monkeypatch.setattr(C.D, "merge_rounds", lambda *a, **k: pytest.fail("12 places need no rounds"))
    monkeypatch.setattr(C, "split_components", lambda *a, **k: pytest.fail("12 places need no components"))
    rows = [("d", "k", i, [i % 12 / 10]) for i in range(120)]
    df = spark.createDataFrame(rows, "dataset string, pkey string, uniq_ord long, embedding array<double>")
    whole, few = ({r["uniq_ord"]: (r["cluster_id"], r["cut_thr"]) for r in
                   C.cluster_lines(df, dist=0.3, cap=cap).collect()} for cap in (1000, 20))
    assert len(few) == 120 and few == whole


@pytest.mark.parametrize("linkage", ["average", "complete"])
def test_half_matrix_shrinks_and_keeps_the_order_of_ties(linkage):
    # 300 points on a grid (many equal distances), as clusters of several points, too
    rng = np.random.default_rng(3)
    x = np.unique(rng.integers(0, 9, size=(400, 3)), axis=0) / 10
    n, w = len(x), rng.integers(1, 4, size=len(x))
    d = K.pairwise_euclidean(x)
    np.fill_diagonal(d, np.inf)
    half = K.half_distances(x)
    assert n > K.ROWS_AT_ONCE and all(np.allclose(half.row(i), d[i]) for i in range(n))
    ids, size, want = np.arange(n), w.astype(float), set()
    while len(ids) > 1:  # every pair that is each other's nearest, over the whole matrix
        near = np.array([K.nearest(d[i], ids[i], ids) for i in range(len(ids))])
        lo = next(i for i in range(len(ids)) if near[near[i]] == i)
        hi = near[lo]
        want.add((int(ids[lo]), int(ids[hi]), float(np.round(d[lo, hi], K.DIGITS))))
        new = (size[lo] * d[lo] + size[hi] * d[hi]) / (size[lo] + size[hi]) if linkage == "average" else np.maximum(d[lo], d[hi])
        new[lo] = np.inf
        d[lo], d[:, lo], size[lo] = new, new, size[lo] + size[hi]
        ids, size, d = np.delete(ids, hi), np.delete(size, hi), np.delete(np.delete(d, hi, 0), hi, 1)
    assert {(a, b, h) for a, b, h in C.nn_chain(x, linkage, sizes=w)} == want
    runs = np.arange(0, n, 3)
    some = K.half_linkage(x, w, runs, linkage)
    all_ = K.linkage_matrix(x, w, runs, x, w, runs, linkage)
    np.fill_diagonal(all_, np.inf)
    assert all(np.allclose(some.row(i), all_[i]) for i in range(len(runs)))
