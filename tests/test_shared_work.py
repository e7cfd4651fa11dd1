"""What many lines or parameter values share is worked out once: sweeps, searches by first token."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from logloom.operators import cross_search, metrics
from logloom.plans import evaluate


def test_values_that_predict_alike_are_evaluated_together(spark):
    """a row that counts for an array of values gives what a row for each value gives."""
    rng = random.Random(3)
    rows = []
    for i in range(60):
        gt = rng.choice(["a", "b", None])
        for part in ([0.1, 0.2], [0.3], [0.4, 0.5]) if i % 3 else ([0.1, 0.2, 0.3, 0.4, 0.5],):
            pred = rng.choice(["p", "q", None])
            rows.append(("d", part, i, f"x {i % 7} y", gt, f"{gt} <*> y" if gt else None, pred, f"{rng.choice('ab')} <*> y"))
    d = spark.createDataFrame(rows, "dataset string, alpha array<double>, line_id long, content string, gt_id string, "
                                    "gt_template string, pred_id string, pred_template string")
    keys = ("dataset", "alpha")
    want = metrics.all_metrics(d.withColumn("alpha", F.explode("alpha")), keys).collect()
    got = metrics.all_metrics(d, keys, each="alpha").collect()
    assert len(got) == 5 and {tuple(r) for r in got} == {tuple(r) for r in want}


def test_alpha_sweep_evaluates_a_line_once(spark, monkeypatch):
    """all alphas choose the same template, so each line comes to the metrics once, not once for each alpha."""
    lines = spark.createDataFrame([("d", i, f"go {i}", f"go {i}", "g", "go <*>") for i in range(5)],
                                  "dataset string, line_id long, content string, normalised string, gt_id string, gt_template string")
    store = spark.createDataFrame([("d", "t", "go <*>", [1.0] + [0.0] * 63, 0)],
                                  "dataset string, template_id string, template string, centroid array<float>, store_ord long")
    seen = []
    true = metrics.all_metrics
    monkeypatch.setattr(metrics, "all_metrics", lambda p, **k: seen.append(p.count()) or true(p, **k))
    out = evaluate.alpha_sweep(lines, store, alphas=(0.1, 0.5, 0.9)).collect()
    assert seen == [5] and len(out) == 3 and {r.GA for r in out} == {1.0} and [r.alpha for r in out if r.best] == [0.1]


def _blocked(text, vec, key, templates, alpha):
    """The greatest score of a store's templates with the text's first token, else of all."""
    tokens = [t.lower() for t in text.split()]
    found = {}
    for store, template, centroid in templates:
        own = template.split()
        fixed = {t.lower() for t in own if t != "<*>"}
        first = own[0].lower() if own else ""
        struct = 0.5 if not fixed else (0.5 * len(fixed & set(tokens)) / len(fixed) + 0.3 * (bool(tokens) and first == tokens[0])
                                        + 0.2 * (1 - abs(len(tokens) - len(own)) / max(len(tokens), len(own), 1)))
        score = None if vec is None or centroid is None else alpha * float(np.dot(vec, centroid)) + (1 - alpha) * struct
        same = first == (tokens[0] if tokens else "")
        found.setdefault(store, []).append((same, score))
    out = {}
    for store, rows in found.items():
        mine = [s for same, s in rows if same] if key is not None else []
        scores = [s for s in (mine or [s for _, s in rows]) if s is not None]
        out[store] = max(scores, default=None)
    return out


def test_keyword_blocked_best_by_blocks(spark, monkeypatch):
    """Stores in many small blocks, repeated texts, lines without tokens, keys or vectors."""
    monkeypatch.setattr(cross_search, "BLOCK", 5)
    rng = random.Random(5)
    words = ["Go", "go", "stop", "run", "<*>", "x1"]
    vec = lambda: [rng.uniform(-1, 1) for _ in range(4)]
    templates = [(rng.choice(["a", "b", "c"]), " ".join(rng.choices(words, k=rng.randrange(5))), None if i % 9 == 4 else vec()) for i in range(23)]
    texts = {" ".join(rng.choices(words + ["new", "odd"], k=rng.randrange(5))): None if i % 8 == 5 else vec() for i in range(30)}
    rows = [(None if i % 11 == 10 else i, t, v) for i, (t, v) in enumerate([*texts.items(), *list(texts.items())[:6]])]
    null_keys = [i for i, r in enumerate(rows) if r[0] is None]
    rows = [r for i, r in enumerate(rows) if r[0] is not None or i == null_keys[0]]  # one line without a key
    lines = spark.createDataFrame(rows, "line_id long, normalised string, embedding array<double>")
    stores = spark.createDataFrame([(s, f"t{i}", t, c, i) for i, (s, t, c) in enumerate(templates)],
                                   "dataset string, template_id string, template string, centroid array<double>, store_ord long")
    got = cross_search.keyword_blocked_best(lines, stores, alpha=0.7).collect()
    want = {(k, store): s for k, t, v in rows for store, s in _blocked(t, v, k, templates, 0.7).items()}
    assert len(got) == len(want) and {(r.line_id, r.dataset) for r in got} == set(want)
    for r in got:
        w = want[r.line_id, r.dataset]
        assert (r.score is None) == (w is None) and (w is None or math.isclose(r.score, w, abs_tol=1e-9))


def test_passes_over_lines_parse_them_once(spark, tmp_path, monkeypatch):
    """What several passes read is parsed by one plan, and read from there."""
    from logloom.plans import catalog
    rows = [(i, 1_700_000_000 + i, i % 3, ["view", "error"][i % 2], '{"k": %d}' % i) for i in range(8)]
    d = spark.createDataFrame(rows, "event_id long, ts long, user_id long, event_type string, props string")
    d.withColumn("ts", F.timestamp_seconds("ts")).write.parquet(f"{tmp_path}/events.parquet")
    kept = catalog._pair_input(spark, str(tmp_path))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan.lower() and kept.count() == 8
    first, calls = catalog.events_pp, []
    monkeypatch.setattr(catalog, "events_pp", lambda *a: calls.append(1) or first(*a))
    catalog.q_match_rate_comparison(spark, str(tmp_path)).collect()
    assert len(calls) == 1
