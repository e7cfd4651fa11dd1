"""Linear models on hashed text, fitted by Spark.

A text's features are its distinct words (runs of letters, digits and non-ASCII
bytes, A-Z lowered), how these begin, its runs of marks, and a few of its measures
in steps, all hashed to `2**BITS` places. A fit keeps the features of a bounded sample of labelled documents as a
table; each quasi-Newton step is a pass in which every partition sends its
gradient, of fixed size. The driver holds weights and gradients, never documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_POWERS, U64, Scratch, hashes_between, mix, prefix_sums, rows_of, word_spans

BITS, STEPS, SMALL, PARTS, BUFFER = 18, 40, 2e-4, 8, 1 << 20  # SMALL: what large weights cost
BETWEEN = np.ones(256, np.int8)
BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 0
NO_MARK = 1 - BETWEEN
NO_MARK[[0x20, *range(0x09, 0x0E)]] = 1
BEGINS = (4, 6)
_SYMBOLS, _UPPER, _DIGITS = b"#*$%&|<>", bytes(range(65, 91)), bytes(range(48, 58))


def features(texts: list[bytes]) -> np.ndarray:
    """For a few texts: number of text and place, distinct and ascending, as text << BITS | place."""
    low = b" ".join(texts).lower()
    begins = np.cumsum([0, *(len(x) + 1 for x in texts[:-1])])
    # Sorted by text and then hash: 56 bits of each hash go along.
    keys = lambda of, hashes: (of.astype(U64) << U64(56)) | (hashes >> U64(8))
    numbered = lambda at: np.searchsorted(begins, at, "right") - 1
    places = lambda k: ((k >> U64(56)) << U64(BITS)) | ((k & U64((1 << 56) - 1)) >> U64(56 - BITS))
    starts, ends = word_spans(low, BETWEEN)
    of = numbered(starts)
    sums = prefix_sums(np.frombuffer(low, np.uint8).astype(U64) + U64(1), BYTE_POWERS)
    words = np.sort(keys(of, hashes_between(sums, starts, ends, BYTE_POWERS)))
    words = words[np.flatnonzero(np.diff(words, prepend=~words[:1]))] if len(words) else words
    mark_starts, mark_ends = word_spans(low, NO_MARK)
    found = [places(words), places(keys(numbered(mark_starts), hashes_between(sums, mark_starts, mark_ends, BYTE_POWERS)))]
    found += [places(keys(of, hashes_between(sums, starts, np.minimum(ends, starts + k), BYTE_POWERS) ^ U64(k))) for k in BEGINS]
    n = np.bincount(of, minlength=len(texts)).tolist()
    distinct = np.bincount((words >> U64(56)).astype(np.int64), minlength=len(texts)).tolist()
    measured = np.empty((len(texts), 6), U64)  # measures, each in its own steps
    for t, data in enumerate(texts):
        size = max(1, len(data))
        share = lambda drop: 1 - len(data.translate(None, drop)) / size  # noqa: B023, E731
        measured[t] = min(20, n[t].bit_length()), *(int(20 * share(x)) for x in (_UPPER, _DIGITS)), min(20, int(50 * share(_SYMBOLS))), min(20, int(200 * share(b"!"))), int(10 * distinct[t] / max(1, n[t]))
    named = mix(measured + U64(1000) * np.arange(1, 7, dtype=U64))
    found.append(places(keys(np.repeat(np.arange(len(texts)), 6), named.ravel())))
    return np.unique(np.concatenate(found).astype(np.int64))


def packed(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """The features of all texts, one after the other, and where each text's begin. A few texts at a time: bounded
    buffers, or one text."""
    found, counts, group, size = [], [], [], 0
    for k, text in enumerate(texts):
        group.append(text or b"")
        size += len(group[-1])
        if size >= BUFFER or len(group) == 256 or k == len(texts) - 1:
            keys = features(group)
            counts.append(np.bincount(keys >> BITS, minlength=len(group)))
            found.append((keys & ((1 << BITS) - 1)).astype(np.int32))
            group, size = [], 0
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    counts = np.concatenate(counts)
    return np.concatenate(found), np.cumsum(counts) - counts


def scores(weights: np.ndarray, places: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row for each text: the sum of its places' weights (each text has a place at least)."""
    return np.add.reduceat(weights[places], starts, axis=0, dtype=np.float64)


def sample(docs: DataFrame, labels: DataFrame, label: F.Column, most: int) -> DataFrame:
    """`text, label` of about `most` labelled documents, dealt by a hash of the id. Rows
    with a null id or label are left out; of labels that share an id, the least counts. The ids are distinct and
    bounded by `most`, so they are broadcast."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), label.cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.min("label").alias("label"))
    share = min(1.0, most / max(1, rows.count()))
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(rows), "doc_id").select("text", "label")


def lowest(value, start: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Where the smooth convex function is lowest, by limited-memory quasi-Newton steps.

    value(x) gives the function and its gradient; a step is shortened until it lowers the function."""
    x, (now, slope) = start, value(start)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []  # move, change of slope, 1 / their product
    for _ in range(steps):
        size = np.sqrt(slope @ slope)
        if size < 1e-9:
            break
        way, weights = slope.copy(), []
        for move, turn, inverse in reversed(moves):
            weights.append(inverse * (move @ way))
            way -= weights[-1] * turn
        way *= moves[-1][0] @ moves[-1][1] / (moves[-1][1] @ moves[-1][1]) if moves else 1 / size
        for (move, turn, inverse), w in zip(moves, reversed(weights), strict=True):
            way += (w - inverse * (turn @ way)) * move
        length, then = 1.0, np.inf
        while length >= 1e-4:
            then, slope_then = value(x - length * way)
            if then <= now - 1e-4 * length * (way @ slope):
                break
            length /= 3
        else:  # no length lowers it: begin anew with the slope alone, or end there
            if not moves:
                break
            moves = []
            continue
        move, turn = -length * way, slope_then - slope
        if move @ turn > 1e-12:
            moves = [*moves, (move, turn, 1 / (move @ turn))][-memory:]
        x, now, slope = x + move, then, slope_then
    return x


def fit(rows: DataFrame, loss, width: int, extra: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (places x width) and `extra` values fitted to `rows` (text, label).

    loss(scores, labels, extra) gives the summed loss, its gradient by the scores (a row for each
    document) and by `extra`. No rows: all weights stay 0, `extra` stays as it is."""
    spark = rows.sparkSession
    places, extra = 1 << BITS, np.array(extra, np.float64)

    def extract(batches):
        for text, label in rows_of(batches, "text", "label"):
            found, starts = packed(text)
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(found)).astype(np.int32)), pa.array(found))
            yield pa.RecordBatch.from_arrays([lists, pa.array(label, pa.int32())], ["places", "label"])

    scratch = Scratch(spark, "fit")
    table = scratch.save(rows.mapInArrow(extract, "places array<int>, label int").repartition(PARTS), "features")

    def summed(x: np.ndarray) -> tuple[float, np.ndarray]:
        sent = spark.sparkContext.broadcast((x[: places * width].reshape(places, width).astype(np.float32), x[places * width :]))

        def gradient(batches):
            weights, more = sent.value
            total, total_more, value, n = np.zeros(weights.shape), np.zeros(more.shape), 0.0, 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                lists, y = batch.column(0), batch.column(1).to_numpy()
                found, counts = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
                part, by_score, by_more = loss(scores(weights, found, np.cumsum(counts) - counts), y, more)
                each = np.repeat(by_score, counts, axis=0)
                for k in range(weights.shape[1]):
                    total[:, k] += np.bincount(found, each[:, k], places)
                total_more, value, n = total_more + by_more, value + part, n + len(y)
            if n:
                row = [total.astype(np.float32).tobytes(), total_more.tobytes(), float(value), n]
                yield pa.RecordBatch.from_arrays([pa.array([b]) for b in row], ["by_weight", "by_more", "value", "n"])

        # A row of fixed size for each partition. They come as Arrow batches: rows would be copied several times in the driver's JVM.
        got = table.mapInArrow(gradient, "by_weight binary, by_more binary, value double, n long").toArrow()
        sent.destroy()
        n, by = max(1, sum(got.column("n").to_pylist())), np.zeros(x.shape)
        for weight, more in zip(got.column("by_weight"), got.column("by_more"), strict=True):
            by += np.concatenate([np.frombuffer(weight.as_buffer(), np.float32), np.frombuffer(more.as_buffer(), np.float64)]) / n
        kept_small = x.copy()
        kept_small[places * width :] = 0
        return sum(got.column("value").to_pylist()) / n + SMALL / 2 * (kept_small @ kept_small), by + SMALL * kept_small

    x = lowest(summed, np.concatenate([np.zeros(places * width), extra]), steps)
    scratch.drop("features")
    return x[: places * width].reshape(places, width).astype(np.float32), x[places * width :]
