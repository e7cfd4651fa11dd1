"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight for each hashed feature is shared by all grades; ordered thresholds
part the score into grades: P(grade <= k) = logistic(threshold[k] - score). A
document gets its expected grade and the probability of the top grades, by which
it is kept. The grades, from the labels: 0 toxic, 1 poor, 2 good.

Fitted on at most about `MOST_LABELLED` labelled documents, dealt by a hash of the
id; every document is scored by its whole text. Null labels and ids take no part
in the fit; null texts are scored as empty; repeated rows are scored each by
itself. With no labelled document at all, every grade has what the first
thresholds give. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashed_linear as H
from .common import rows_of, texts

GRADES, MOST_LABELLED, LEAST_TAIL = 3, 20_000, 0.5
COLUMNS = "doc_id long, score double, expected_grade double, tail_probability double"


def grade() -> F.Column:
    """0 toxic, 1 poor, 2 good; null where a label is missing."""
    return F.when(F.col("quality").isNull() | F.col("toxic").isNull(), None).when(F.col("toxic") > 0, 0).when(F.col("quality") < 1, 1).otherwise(2)


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def at_most(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade <= k) for k = -1 .. GRADES - 1, a column each."""
    inner = logistic(thresholds[None, :] - score[:, None])
    return np.column_stack([np.zeros(len(score)), inner, np.ones(len(score))])


def loss(s: np.ndarray, y: np.ndarray, thresholds: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    below = at_most(s[:, 0], thresholds)
    rows = np.arange(len(y))
    a, b = below[rows, y + 1], below[rows, y]
    inside = np.maximum(a - b, 1e-12)
    by_threshold = np.zeros((len(y), len(thresholds) + 2))
    by_threshold[rows, y + 1] -= a * (1 - a) / inside
    by_threshold[rows, y] += b * (1 - b) / inside
    return -np.log(inside).sum(), (1 - a - b)[:, None], by_threshold[:, 1:-1].sum(axis=0)


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and the thresholds."""
    rows = H.sample(docs, labels, grade(), most_labelled)
    start = np.linspace(-1, 1, GRADES - 1)
    weights, thresholds = H.fit(rows, loss, 1, start)  # out of order, a grade's probability is 0 and the loss high
    return weights[:, 0], thresholds


def rate(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], least_tail: float = LEAST_TAIL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """COLUMNS and `kept` for every document; the tail is the top grade."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches):
        weights, thresholds = sent.value
        for ids, data in rows_of(batches, "doc_id", "text"):
            score = H.scores(weights, *H.packed(data))
            above = 1 - at_most(score, thresholds)[:, 1:-1]  # P(grade > k)
            values = [score, above.sum(axis=1), above[:, -1]]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(v) for v in values)], [c.split()[0] for c in COLUMNS.split(", ")])

    return texts(docs, id_col, text_col).mapInArrow(run, COLUMNS).withColumn("kept", F.col("tail_probability") >= least_tail)


def classify(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, least_tail: float = LEAST_TAIL) -> DataFrame:
    return rate(docs, fit(docs, labels, most_labelled), least_tail)
