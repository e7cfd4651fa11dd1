"""Mixing sources to target weights by soft membership.

A softmax classifier on hashed text, fitted on the labelled table, gives each
document a posterior over the domains: nothing belongs to one domain alone.
Document rates, all at least 0, are then fitted so that the expected tokens of
each domain (rate x tokens x posterior, summed) are the target's share of a token
budget, by projected gradient descent on the squared differences. Steps are
measured in tokens: a document's rate moves by its posterior times the domains'
differences, solved against the token-weighted moments of the posteriors, and is
cut off at 0 (and at `most`, if given: a domain that hardly occurs is then not
repeated without end, and misses its target). Rates are never collected: a rate is a
function of the posterior and of the few steps so far. Rates start at 1, so
documents keep their weight where targets allow it. Steps go on until targets are
met or no step of any size brings them nearer; `expected` tells how near.

A rate of 2.3 means two copies and a third one for 3 documents in 10, by a hash of
the id and the text. Domains, from the labels: toxic, poor, good.

The classifier is fitted on at most about `MOST_LABELLED` labelled documents, dealt
by a hash of the id; all sums go over all documents. Null texts count as empty and
have no tokens; null ids are dealt like any id; repeated rows count as often as
they come; columns of any name go along. With no token at all, every rate stays 1. Targets that no rates can
meet are met as nearly as the steps get.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashed_linear as H
from .common import Scratch, carried, free_names, texts

DOMAINS = ("toxic", "poor", "good")
TARGETS = {"toxic": 0.01, "poor": 0.03, "good": 0.96}
MOST_LABELLED, MOST_RATE, CLOSE, HALVINGS = 20_000, float("inf"), 1e-6, 30
TOKENS, POSTERIOR = "__n_tokens", "__posterior"  # made longer where the input has such columns


def domain() -> F.Column:
    """The number of the label's domain; null where a label is missing."""
    return F.when(F.col("quality").isNull() | F.col("toxic").isNull(), None).when(F.col("toxic") > 0, 0).when(F.col("quality") < 1, 1).otherwise(2)


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def loss(s: np.ndarray, y: np.ndarray, bias: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    p = softmax(s + bias)
    rows = np.arange(len(y))
    value = -np.log(np.maximum(p[rows, y], 1e-300)).sum()
    p[rows, y] -= 1
    return value, p, p.sum(axis=0)


def fit(docs: DataFrame, labels: DataFrame, label: F.Column, domains: int, most_labelled: int = MOST_LABELLED):
    rows = H.sample(docs, labels, label, most_labelled)
    return H.fit(rows, loss, domains, np.zeros(domains))


def posteriors(docs: DataFrame, model, text_col: str = "text", tokens: str = TOKENS, posterior: str = POSTERIOR) -> DataFrame:
    """`docs` with `tokens` (words) and `posterior`."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(data):
        weights, bias = sent.value
        p = softmax(H.scores(weights, *H.packed(data)) + bias)
        offsets = np.arange(0, p.size + 1, p.shape[1]).astype(np.int32)
        return [pa.array([len((x or b"").split()) for x in data], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(p.ravel()))]

    return carried(docs, run, f"{tokens} long, {posterior} array<double>", text_col)


def rate(steps: list[np.ndarray], most: float = MOST_RATE, posterior: str = POSTERIOR) -> F.Column:
    """A document's rate after `steps`, from its `posterior`; its size does not grow with the fit."""
    if not steps:
        return F.lit(1.0)
    moved = lambda r, step: r + F.aggregate(F.arrays_zip(F.col(posterior).alias("p"), step.alias("s")), F.lit(0.0), lambda a, x: a + x["p"] * x["s"])
    all_steps = F.array(*(F.array(*(F.lit(float(x)) for x in step)) for step in steps))
    return F.aggregate(all_steps, F.lit(1.0), lambda r, step: F.least(F.lit(float(most)), F.greatest(F.lit(0.0), moved(r, step))))


class Sums:
    """Of documents with `tokens` and `posterior`, all that the driver sees: a few numbers for each domain."""

    def __init__(self, members: DataFrame, domains: int, most: float = MOST_RATE, tokens: str = TOKENS, posterior: str = POSTERIOR):
        self.members, self.k, self.most, self.tokens, self.posterior = members, domains, most, tokens, posterior

    def __call__(self, steps: list[np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
        """All tokens, the domains' expected tokens at the rates after `steps`, and the moments of documents whose
        rate can still move, by which a step is measured."""
        k, n, r = self.k, F.col(self.tokens).cast("double"), F.col("r")
        p = [F.get(self.posterior, F.lit(i)) for i in range(k)]
        free = F.when((r > 0) & (r < self.most), n).otherwise(0.0)
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        rows = self.members.select(self.tokens, self.posterior, rate(steps, self.most, self.posterior).alias("r"))
        row = [x or 0.0 for x in rows.agg(F.sum(n), *(F.sum(n * p[i] * r) for i in range(k)), *(F.sum(free * p[i] * p[j]) for i, j in pairs)).first()]
        h = np.zeros((k, k))
        for (i, j), x in zip(pairs, row[1 + k :], strict=True):
            h[i, j] = h[j, i] = x
        return row[0], np.array(row[1 : 1 + k]), h


def fit_rates(sums: Sums, shares: list[float], budget: float | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Steps after which the domains' expected tokens are `shares` of `budget` (default: the tokens there are), and
    the expected and the target tokens.

    A step that brings no gain is halved."""
    total, now, h = sums([])
    target = np.array(shares) / sum(shares) * (budget or total)
    steps: list[np.ndarray] = []
    halved = 0
    while total and np.abs(off := target - now).max() > CLOSE * target.sum() and halved < HALVINGS:
        step = np.linalg.solve(h + np.eye(sums.k) * 1e-6 * total, off)
        then, h_then = sums([*steps, step])[1:]
        before, after = (off**2).sum(), ((target - then) ** 2).sum()
        if after < before * (1 - 1e-9):
            steps, now, h, halved = [*steps, step], then, h_then, 0
        else:
            h, halved = 2 * h + np.eye(sums.k) * 1e-3 * total, halved + 1
    return steps, now, target


def copies(rate_col: F.Column, dealt: F.Column) -> F.Column:
    """The rate as a whole number of copies, right on average. dealt: a hash of the row."""
    unit = F.pmod(dealt, F.lit(1 << 40)) / F.lit(float(1 << 40))
    return (F.floor(rate_col) + (unit < rate_col - F.floor(rate_col)).cast("long")).cast("long")


def deal(seed: int = 17) -> F.Column:
    return F.xxhash64("doc_id", "text", F.lit(seed))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, label: F.Column | None = None, budget: float | None = None, most: float = MOST_RATE) -> DataFrame:
    """`doc_id, n_tokens, p_<domain>, rate, copies` for every document.

    targets: the share of each domain, in the order of their numbers; label: the number of a
    labelled row's domain (default: DOMAINS); most: no document's rate is higher."""
    targets = targets or TARGETS
    model = fit(docs, labels, domain() if label is None else label, len(targets))
    rows = texts(docs).withColumn("deal", deal())
    members = Scratch(docs.sparkSession, "mixing").save(posteriors(rows, model).drop("text"), "members")
    steps, _, _ = fit_rates(Sums(members, len(targets), most), list(targets.values()), budget)
    out = members.withColumn("rate", rate(steps, most))
    return out.select("doc_id", F.col(TOKENS).alias("n_tokens"), *(F.get(POSTERIOR, F.lit(k)).alias(f"p_{d}") for k, d in enumerate(targets)), "rate", copies(F.col("rate"), F.col("deal")).alias("copies"))


def expected(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, label: F.Column | None = None, budget: float | None = None, most: float = MOST_RATE) -> DataFrame:
    """`domain, target_tokens, expected_tokens`: how near the fitted rates come to the targets."""
    targets = targets or TARGETS
    model = fit(docs, labels, domain() if label is None else label, len(targets))
    members = Scratch(docs.sparkSession, "mixing").save(posteriors(texts(docs), model).drop("text"), "members")
    _, now, target = fit_rates(Sums(members, len(targets), most), list(targets.values()), budget)
    return docs.sparkSession.createDataFrame([(d, float(t), float(x)) for d, t, x in zip(targets, target, now, strict=True)], "domain string, target_tokens double, expected_tokens double")


def resampled(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, label: F.Column | None = None, budget: float | None = None, most: float = MOST_RATE) -> DataFrame:
    """The rows of `docs`, each as often as its rate says, in the columns of `docs`. Texts are scored once."""
    targets = targets or TARGETS
    model = fit(docs, labels, domain() if label is None else label, len(targets))
    tokens, posterior, often = free_names(docs, TOKENS, POSTERIOR, "__copies")
    rows = Scratch(docs.sparkSession, "mixing").save(posteriors(docs, model, "text", tokens, posterior), "scored")
    steps, _, _ = fit_rates(Sums(rows, len(targets), most, tokens, posterior), list(targets.values()), budget)
    rows = rows.withColumn(often, copies(rate(steps, most, posterior), deal())).where(F.col(often) > 0)
    return rows.select(*(f"`{c}`" for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col(often).cast("int"))).alias(often)).drop(often)
