"""Top-k over all stores, the running threshold and line numbers: each against a plain version."""

import random

import numpy as np
import pytest

from logloom.operators import cross_search as X
from logloom.sources import files
from logloom.streaming import monitor

STORE = "dataset string, template_id string, template string, centroid array<float>, store_ord long"
LINES = "line_id long, normalised string, embedding array<float>"


def unit(rnd, near=None):
    v = rnd.normal(size=8) if near is None else near + 0.3 * rnd.normal(size=8)
    return [float(np.float32(x)) for x in v / np.linalg.norm(v)]


def tables(seed, n_store=300, n_lines=60):
    rnd = np.random.default_rng(seed)
    words = [f"W{k}" for k in range(40)] + ["<*>"] * 8
    store, lines = [], []
    for k in range(n_store):
        toks = [words[rnd.integers(len(words))] for _ in range(rnd.integers(1, 7))]
        store.append([f"d{k % 3}", f"id{k}", " ".join(toks), unit(rnd), k])
    for k in range(n_lines):
        _, _, template, c, _ = store[rnd.integers(n_store)]
        text = " ".join(w if w != "<*>" else f"v{rnd.integers(9)}" for w in template.lower().split())
        lines.append([k, text, unit(rnd, np.array(c))])
    store += [["d0", "same", store[5][2], store[5][3], 1000], ["d1", "all", "<*> <*>", unit(rnd), 1001], ["d2", "none", "", unit(rnd), 1002]]
    by_text = {t: v for _, t, v in lines}
    lines = [[k, t, by_text[t]] for k, t, _ in lines] + [[900, lines[0][1], by_text[lines[0][1]]], [901, "", unit(rnd)], [902, "x", None]]
    return store, lines


def plain_topk(store, lines, k, alpha):
    out = []
    for line, text, v in lines:
        toks = text.lower().split()
        if not toks or v is None:
            continue
        scored = []
        for ds, tid, template, c, at in store:
            tt = template.split()
            fixed = [t.lower() for t in tt if t != "<*>"]
            first = (tt[0].lower() if tt else "") == toks[0]
            alike = 1 - abs(len(toks) - len(tt)) / max(len(toks), len(tt), 1)
            struct = 0.5 * sum(t in toks for t in fixed) / len(fixed) + 0.3 * first + 0.2 * alike if fixed else 0.3
            scored.append((-round(alpha * float(np.dot(v, c)) + (1 - alpha) * struct, 6), ds, at, tid))
        out += [(line, r + 1, ds, tid, -s) for r, (s, ds, _, tid) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("block", "k", "alpha"), [(4096, 3, 0.5), (37, 3, 0.5), (37, 1, 0.9), (5, 400, 0.2)])
def test_cross_store_topk_equals_all_pairs(spark, monkeypatch, block, k, alpha):
    monkeypatch.setattr(X, "BLOCK", block)
    store, lines = tables(block + k)
    s, ln = spark.createDataFrame(store, STORE), spark.createDataFrame(lines, LINES)
    got = X.cross_store_topk(ln, s, k, alpha)
    assert got.columns == ["line_id", "rank", "store_dataset", "template_id", "template", "score"]
    got = sorted((r.line_id, r["rank"], r.store_dataset, r.template_id, round(r.score, 6)) for r in got.collect())
    assert got == plain_topk(store, lines, k, alpha)


def test_few_pairs_are_scored(spark):
    store, lines = tables(3, 2000, 80)
    r = X.pairs_scored(spark.createDataFrame(lines, LINES), spark.createDataFrame(store, STORE)).first()
    assert r.pairs == len(store) * len({t for _, t, v in lines if t and v}) and r.scored < 0.1 * r.pairs


def test_search_of_empty_tables(spark):
    store, lines = tables(4, 9, 5)
    none = spark.createDataFrame([], STORE), spark.createDataFrame([], LINES)
    assert X.cross_store_topk(spark.createDataFrame(lines, LINES), none[0]).count() == 0
    assert X.cross_store_topk(none[1], spark.createDataFrame(store, STORE)).count() == 0


@pytest.mark.parametrize("width", [256, 3])
def test_running_threshold_is_the_sequential_walk(spark, monkeypatch, width):
    monkeypatch.setattr(monitor, "WIDTH", width)
    rnd, rows, want = random.Random(width), [], {}
    for ds, n, ways in (("a", 100, (1, 1, 0, -1)), ("b", 37, (-1, -1, 0, 1)), ("c", 1, (1,))):
        x = 0.20
        for k in range(n):
            s = rnd.choice(ways)
            x = min(0.55, max(0.05, x + 0.01 * s))
            rows.append((ds, 100 * (k + 1), s))
            want[ds, 100 * (k + 1)] = round(x, 6)
    rnd.shuffle(rows)
    got = monitor.running_threshold(spark.createDataFrame(rows, "dataset string, checkpoint long, step int"))
    assert {(r.dataset, r.checkpoint): r.threshold for r in got.collect()} == want
    assert monitor.running_threshold(spark.createDataFrame([], "dataset string, checkpoint long, step int")).count() == 0


def test_line_ids_follow_file_names_whatever_the_sizes(spark, tmp_path):
    parts = {"a.log": [f"a{k}" for k in range(3)], "b.log": ["", "b1", " "], "c.log": [f"c{k} {'x' * 50}" for k in range(4000)], "d.log": ["d0"]}
    for name, lines in parts.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = [t for name in sorted(parts) for t in parts[name]]
    for size in (was, "16384"):  # one split a file, and many
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = files.raw_lines(spark, str(tmp_path), "d")
            got = sorted((r.line_id, r.raw) for r in rows.collect())
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        assert got == list(enumerate(want, 1))
    assert "Python" not in rows._jdf.queryExecution().toString()
    assert files.non_blank_lines(spark, str(tmp_path)).count() == sum(bool(t.strip()) for t in want)
