"""op2 and op6: gradients, held-out accuracy, targets, odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from texts import SCHEMA, prose

from logloom.llm import hashed_linear as H
from logloom.llm import ordinal_quality as O
from logloom.llm import soft_mixing as M

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark):
    """300 labelled documents are few, so the bounds are wide. Good, poor (marks) and toxic (a few words with a common beginning) documents; half are labelled."""
    rnd, docs, labels = random.Random(5), [], []
    for d in range(600):
        kind = rnd.choices(("good", "poor", "toxic"), (6, 2, 2))[0]
        text = prose(rnd, rnd.randint(20, 200), 900)
        if kind == "poor":
            text = " ".join(f"{w}{rnd.choice(['###', '%%%', '&&&'])}" for w in text.split())
        if kind == "toxic":
            words = text.split()
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), f"vile{rnd.randrange(40)}")
            text = " ".join(words)
        docs.append((d, text, kind))
        if d % 2:
            labels.append((d, int(kind != "poor"), int(kind == "toxic")))
    labels += [(None, 1, 0), (1, None, 0), (3, 1, None), (99_999, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, kind string"), spark.createDataFrame(labels, LABELS)


def slopes_hold(loss, width, extra):
    rnd = np.random.default_rng(1)
    s, y = rnd.normal(size=(30, width)), rnd.integers(0, 3, 30)
    value, by_score, by_extra = loss(s, y, extra)
    for _ in range(20):
        ds, dx = rnd.normal(size=s.shape) * 1e-5, rnd.normal(size=extra.shape) * 1e-5
        change = loss(s + ds, y, extra + dx)[0] - loss(s - ds, y, extra - dx)[0]
        assert abs(change - 2 * ((by_score * ds).sum() + (by_extra * dx).sum())) < 1e-7


def test_gradients():
    slopes_hold(O.loss, 1, np.array([-0.7, 1.1]))
    slopes_hold(M.loss, 3, np.array([0.2, -0.1, 0.4]))


def test_lowest_finds_the_least():
    a = np.diag([1.0, 10.0, 100.0])
    found = H.lowest(lambda x: (0.5 * x @ a @ x - x.sum(), a @ x - 1), np.zeros(3), 60)
    assert np.allclose(found, [1, 0.1, 0.01], atol=1e-4)


def test_features_of_odd_texts():
    for text in (b"", b" \n", "é 日本 ###".encode(), b"a" * 100_000):
        places, _ = H.packed([text])
        assert len(places) and places.min() >= 0 and places.max() < 1 << H.BITS and (np.diff(places) > 0).all()


def test_grades_of_unseen_documents(spark, tables):
    docs, labels = tables
    got = O.classify(docs, labels).join(docs.select("doc_id", "kind"), "doc_id").where("doc_id % 2 = 0").collect()
    kept = {k: np.mean([r.kept for r in got if r.kind == k]) for k in ("good", "poor", "toxic")}
    assert kept["good"] > 0.85 and kept["poor"] < 0.1 and kept["toxic"] < 0.2, kept
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in got)
    mean = {k: np.mean([r.expected_grade for r in got if r.kind == k]) for k in kept}
    assert mean["toxic"] < mean["poor"] < mean["good"]


def test_models_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, None), (None, "a"), (2, ""), (2, "")], SCHEMA)
    none = spark.createDataFrame([], LABELS)
    rows = O.classify(docs, none).collect()
    assert len(rows) == 4 and len({r.tail_probability for r in rows}) == 1
    mixed = M.mixed(docs, none).collect()
    assert len(mixed) == 4 and all(abs(r.p_good - 1 / 3) < 1e-9 for r in mixed)
    empty = spark.createDataFrame([], SCHEMA)
    assert O.classify(empty, none).count() == 0 and M.mixed(empty, none).count() == 0 and M.resampled(empty, none).count() == 0


def test_expected_tokens_meet_the_targets(spark, tables):
    docs, labels = tables
    rows = M.mixed(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.rate <= M.MOST_RATE for r in rows)
    total = sum(r.n_tokens for r in rows)
    for name, share in M.TARGETS.items():
        assert abs(sum(r.rate * r.n_tokens * r[f"p_{name}"] for r in rows) / total - share) < 1e-3, name
    assert abs(sum(r.copies for r in rows) - sum(r.rate for r in rows)) < 5 * len(rows) ** 0.5


def test_rates_are_cut_off(spark):
    rows = [(100, [1.0, 0.0]), (100, [0.9, 0.1])] * 10
    members = spark.createDataFrame(rows, f"{M.TOKENS} long, {M.POSTERIOR} array<double>")
    steps, now, target = M.fit_rates(M.Sums(members, 2, most=2.0), [0.05, 0.95])
    assert np.isclose(target.sum(), 2000) and now.sum() < 2000  # out of reach
    rates = [r[0] for r in members.select(M.rate(steps, 2.0)).collect()]
    assert min(rates) >= 0 and max(rates) <= 2


def test_resampled_rows_come_as_often_as_told(spark, tables):
    docs, labels = tables
    docs = docs.withColumn("copies", F.lit("x")).withColumn("posterior", F.lit(1))
    out = M.resampled(docs, labels)
    assert out.columns == docs.columns
    want = {r.doc_id: r.copies for r in M.mixed(docs, labels).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == want


def plain_features(data):
    """One text at a time, one kind at a time."""
    from logloom.llm.common import U64, mix, word_hashes, word_spans

    low = data.lower()
    spans = starts, ends = word_spans(low, H.BETWEEN)
    words = np.unique(word_hashes(low, spans))
    begins = [np.unique(word_hashes(low, (starts, np.minimum(ends, starts + k)))) ^ U64(k) for k in H.BEGINS]
    n, size = len(starts), max(1, len(data))
    share = lambda drop: 1 - sum(b not in drop for b in data) / size
    told = [min(20, n.bit_length()), int(20 * share(H._UPPER)), int(20 * share(H._DIGITS)), min(20, int(50 * share(H._SYMBOLS))), min(20, int(200 * share(b"!"))), int(10 * len(words) / max(1, n))]
    named = mix(np.array([(k + 1) * 1000 + m for k, m in enumerate(told)], U64))
    return np.unique(np.concatenate([words, word_hashes(low, word_spans(low, H.NO_MARK)), *begins, named]) >> U64(64 - H.BITS)).astype(np.int32)


def test_features_of_a_buffer_are_those_of_each_text(monkeypatch):
    rnd = random.Random(9)
    texts = [None, b"", b"!!!", "É ñ 日本 ###".encode()] + [" ".join(rnd.choice(["Ab", "cdefghij", "x1", "--", "é", "9"]) for _ in range(rnd.randint(0, 300))).encode() for _ in range(300)]
    for buffer in (1 << 20, 500):
        monkeypatch.setattr(H, "BUFFER", buffer)
        found, starts = H.packed(texts)
        for text, a, b in zip(texts, starts, [*starts[1:], len(found)], strict=True):
            want = plain_features(text or b"")
            assert found[a:b].tolist() == want.tolist()


def test_lowest_never_takes_a_step_up():
    seen = []

    def value(x):  # a kink that quasi-Newton steps overshoot
        seen.append(float(np.abs(x).sum()))
        return float(np.abs(x).sum()), np.sign(x)

    found = H.lowest(value, np.array([3.0, -2.0, 0.5]), 50)
    assert np.abs(found).sum() <= 5.5 and np.isclose(np.abs(found).sum(), min(seen), atol=1e-9)


def test_rare_domains_meet_their_targets(spark):
    """A domain of 1 % gets half of the tokens: without a cap its rate goes up as far as it must."""
    rows = [(100, [1.0, 0.0])] * 2 + [(100, [0.0, 1.0])] * 198
    members = spark.createDataFrame(rows, f"{M.TOKENS} long, {M.POSTERIOR} array<double>")
    steps, now, target = M.fit_rates(M.Sums(members, 2), [0.5, 0.5])
    assert np.allclose(now, target, rtol=1e-4)
    assert abs(max(r[0] for r in members.select(M.rate(steps)).collect()) - 50) < 0.1


def test_mixing_keeps_clashing_columns_and_tells_how_near(spark, tables):
    docs, labels = tables
    docs = docs.select("doc_id", "text", F.lit(1.5).alias(M.TOKENS), F.lit("p").alias(M.POSTERIOR), F.lit(2).alias("__copies"))
    out = M.resampled(docs, labels)
    assert out.columns == docs.columns and {(r[2], r[3], r[4]) for r in out.collect()} == {(1.5, "p", 2)}
    for r in M.expected(docs, labels).collect():
        assert abs(r.expected_tokens - r.target_tokens) < 1e-3 * max(1, r.target_tokens), r


def test_a_fit_collects_no_rows(spark, monkeypatch):
    """Gradients come as Arrow batches; as rows, each was copied several times in the driver's JVM (1.5 GB for op6)."""
    rnd = random.Random(3)
    rows = [(" ".join(rnd.choice("abcdefgh") + str(k) for _ in range(9)), k) for k in (0, 1, 2) for _ in range(20)]
    docs = spark.createDataFrame(rows, "text string, label int").repartition(7)
    monkeypatch.setattr(type(docs), "collect", None)
    weights, bias = H.fit(docs, M.loss, 3, np.zeros(3))
    found = H.scores(weights, *H.packed([t.encode() for t, _ in rows])) + bias
    assert (found.argmax(axis=1) == [k for _, k in rows]).all() and np.allclose(weights.sum(axis=1), 0, atol=1e-3)
