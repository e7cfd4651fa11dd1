"""Ranked lexical search: a hybrid of term-at-a-time and document-at-a-time.

A term is a run of ASCII letters, digits and code points above 0x7F, with A-Z
lowered. A term's weight is floor(1000 ln((2N+2)/(2df+1))); a document's share of it
is (10^9 tf) div (1000 tf + 12 m), m = 75 + (25 n N) div L, all in 64-bit integers
(N documents with a term, L terms in all, n in the document). A score is the sum of
weight times share over the query's terms, repeats included.

Queries are a stated set. They are read in blocks of bounded size; for each block

1. one pass over the documents counts the query terms of each (no shuffle), and the
   result, a row for each document, is written. N, L and df are sums over it;
2. each task indexes its own documents, a bounded chunk at a time, in lists of
   (document, share) by term, with the greatest share of each run of `RUN` documents.
   A query's short lists are summed first, term at a time, into accumulators. These
   then are one more list, with bounds of its own, beside the long lists, and the
   documents are walked in order: a run whose bounds together stay below the query's
   20th score so far is skipped whole; in a run that is not, lists that could not
   lift a document to that score alone are only looked up for documents that others
   have brought up. Scores held go along from chunk to chunk;
3. each task gives its best documents of each query, and a window takes the best of
   these. No document's text is shuffled.

Terms are known by 64-bit hashes.

Null and empty texts have no term, count for nothing and are never found. Null
document ids rank after all others of equal score. Rows that repeat an id are
documents of their own. Of queries that share an id (null is one), the least text
counts; queries without terms find nothing. Other columns are ignored. An empty
table on either side gives an empty result. Texts are taken whole, in pieces of
bounded size that end between terms.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BYTE_POWERS, U64, Scratch, rows_of, spans_hash

#: A block of queries, and a chunk of documents, at most (or one query, one document).
QUERIES_AT_ONCE, QUERY_BYTES, CHUNK_DOCS, CHUNK_POSTINGS = 10_000, 2 << 20, 65_536, 8_000_000
#: Documents that share a bound; a list is short if it has less than one posting for SPARSE documents.
RUN, SPARSE, PIECE = 1024, 64, 4 << 20
LAST = (1 << 63) - 1  # stands for a null id
COUNTS, FOUND = "doc_id long, n long, terms array<int>, tfs array<int>", "query int, doc_id long, score long"

#: Bytes of terms, lowered; 0 between terms.
LOWERED = np.zeros(256, np.uint8)
LOWERED[0x80:] = np.arange(0x80, 0x100)
for _b in b"0123456789abcdefghijklmnopqrstuvwxyz":
    LOWERED[_b] = _b
LOWERED[0x41:0x5B] = LOWERED[0x61:0x7B]


def _pieces(low: np.ndarray):
    """Cuts of a buffer, each between two terms."""
    at = 0
    while at < len(low):
        to = at + PIECE
        while to < len(low) and not (gap := np.flatnonzero(low[to : to + PIECE] == 0)).size:
            to += PIECE
        to = len(low) if to >= len(low) else to + int(gap[0])
        yield at, to
        at = to


def terms_in(data: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """For every term of the texts, in order: the number of its text, and its hash."""
    low = LOWERED[np.frombuffer(b"\0".join(x or b"" for x in data), np.uint8)]
    begins = np.cumsum([0, *(len(x or b"") + 1 for x in data[:-1])]) if data else np.zeros(0, np.int64)
    texts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    for at, to in _pieces(low):
        inside = np.zeros(to - at + 2, np.int8)
        inside[1:-1] = low[at:to] != 0
        turn = np.diff(inside)
        starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        texts.append(np.searchsorted(begins, starts + at, "right") - 1)
        hashes.append(spans_hash(low[at:to].astype(U64), starts, ends, BYTE_POWERS))
    return np.concatenate(texts), np.concatenate(hashes)


def term_counts(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """COUNTS for every document: its number of terms, and how often it has which of `vocabulary` (ascending hashes)."""

    def run(batches):
        for ids, data in rows_of(batches, "doc_id", "text"):
            text, hashes = terms_in(data)
            place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
            known = vocabulary[place] == hashes
            keys, tfs = np.unique(text[known] * len(vocabulary) + place[known], return_counts=True)
            ends = pa.array(np.searchsorted(keys, np.arange(len(ids) + 1) * len(vocabulary)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (keys % len(vocabulary), tfs)]
            n = np.bincount(text, minlength=len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, COUNTS)


class Best:
    """The `k` best of a query so far: greatest scores, then least ids."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def bar(self) -> int:
        """What a score must reach."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        first = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[first], ids[first]


class Chunk:
    """Lists of a bounded number of documents: for each term, documents in order and their shares."""

    def __init__(self, ids, sizes, ends, terms, tfs, n_all: int, length: int):
        """ends: of each document's part of `terms` and `tfs`."""
        self.ids, self.n_runs = ids, -(-len(ids) // RUN)
        docs = np.repeat(np.arange(len(ids)), np.diff(ends))
        m = np.array([75 + 25 * int(n) * n_all // length for n in sizes], np.int64)
        shares = 1_000_000_000 * tfs // (1000 * tfs + 12 * m[docs])
        order = np.argsort(terms, kind="stable")
        self.docs, self.shares = docs[order], shares[order]
        runs = terms[order] * self.n_runs + self.docs // RUN
        self.at = np.flatnonzero(np.diff(runs, prepend=-1))  # where each run of a list begins
        self.runs = runs[self.at]
        self.bounds = np.maximum.reduceat(self.shares, self.at) if len(self.at) else self.shares
        self.at = np.append(self.at, len(runs))
        self.walked = 0  # runs not skipped

    def _runs_of(self, term: int) -> tuple[int, int]:
        a, b = np.searchsorted(self.runs, (term * self.n_runs, (term + 1) * self.n_runs))
        return int(a), int(b)

    def _accumulated(self, lists) -> tuple[np.ndarray, np.ndarray]:
        """Term at a time: the documents of the short lists and their sums."""
        docs = np.concatenate([self.docs[self.at[a] : self.at[b]] for a, b, _ in lists])
        sums = np.concatenate([weight * self.shares[self.at[a] : self.at[b]] for a, b, weight in lists])
        order = np.argsort(docs, kind="stable")
        docs = docs[order]
        first = np.flatnonzero(np.diff(docs, prepend=-1))
        return docs[first], np.add.reduceat(sums[order], first)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Add what this chunk has for the query `terms`, of positive `weights`."""
        lists = [(*self._runs_of(t), int(w)) for t, w in zip(terms, weights, strict=True)]
        lists = [x for x in lists if x[1] > x[0]]
        short = [x for x in lists if (self.at[x[1]] - self.at[x[0]]) * SPARSE < len(self.ids)]
        # Every iterator: its postings, what a posting weighs, its bound in each run, and where each run begins and ends.
        iterators = []
        if short:
            docs, sums = self._accumulated(short)
            runs, at = np.unique(docs // RUN, return_index=True)
            iterators.append((docs, sums, 1, runs, np.maximum.reduceat(sums, at), np.append(at, len(docs))))
        for a, b, weight in (x for x in lists if x not in short):
            iterators.append((self.docs, self.shares, weight, self.runs[a:b] % self.n_runs, weight * self.bounds[a:b], self.at[a : b + 1]))
        if not iterators:
            return
        bound = np.zeros((len(iterators), self.n_runs), np.int64)
        place = np.zeros((len(iterators), self.n_runs), np.int64)
        for k, (_, _, _, runs, bounds, _) in enumerate(iterators):
            bound[k, runs], place[k, runs] = bounds, np.arange(len(runs))
        total = bound.sum(axis=0)
        for run in np.flatnonzero(total >= best.bar):
            if total[run] >= best.bar:  # it may have risen
                self._walk(int(run), iterators, bound[:, run], place[:, run], best)

    def _walk(self, run: int, iterators, bound, place, best: Best) -> None:
        self.walked += 1
        base, bar = run * RUN, best.bar
        scores = np.zeros(min(RUN, len(self.ids) - base), np.int64)
        left = int(bound.sum())
        up = None  # documents that may still reach the bar, once the lists left cannot reach it alone
        for k in np.argsort(-bound, kind="stable"):
            if not bound[k]:
                break
            docs, values, weight, _, _, at = iterators[k]
            a, b = at[place[k]], at[place[k] + 1]
            if up is None and left < bar:
                up = np.flatnonzero(scores)
            if up is None:
                scores[docs[a:b] - base] += weight * values[a:b]
            else:
                up = up[scores[up] + left >= bar]
                if not len(up):
                    return
                to = np.minimum(a + np.searchsorted(docs[a:b], up + base), b - 1)
                met = docs[to] == up + base
                scores[up[met]] += weight * values[to[met]]
            left -= int(bound[k])
        up = np.flatnonzero(scores >= bar) if up is None else up[scores[up] >= bar]
        if len(up):
            best.add(scores[up], self.ids[base + up])


def chunks(batches, n_all: int, length: int):
    """Chunks of the rows of COUNTS that have a query term."""
    parts, n_docs, n_postings = [], 0, 0

    def chunk():
        ids, sizes, counts, terms, tfs = (np.concatenate(x) for x in zip(*parts, strict=True))
        return Chunk(ids, sizes, np.concatenate([[0], np.cumsum(counts)]), terms, tfs, n_all, length)

    for batch in batches:
        for at in range(0, batch.num_rows, RUN):
            part = batch.slice(at, RUN)
            ids, sizes, terms, tfs = (part.column(k) for k in range(4))
            counts = terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            has = counts > 0
            if not has.any():
                continue
            flat = [x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (terms, tfs)]
            parts.append((ids.fill_null(LAST).to_numpy(zero_copy_only=False)[has], sizes.to_numpy(zero_copy_only=False)[has], counts[has], *flat))
            n_docs, n_postings = n_docs + int(has.sum()), n_postings + len(flat[0])
            if n_docs >= CHUNK_DOCS or n_postings >= CHUNK_POSTINGS:
                yield chunk()
                parts, n_docs, n_postings = [], 0, 0
    if parts:
        yield chunk()


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _block(docs: DataFrame, queries: list[tuple], k: int, scratch: Scratch, name: str) -> DataFrame | None:
    """`query, doc_id, score` of the best of every task; queries: (id, text)."""
    spark = docs.sparkSession
    of, hashes = terms_in([(text or "").encode() for _, text in queries])
    if not len(hashes):
        return None
    vocabulary, number = np.unique(hashes, return_inverse=True)
    counts = scratch.save(term_counts(docs, vocabulary), f"counts-{name}")
    n_all, length = counts.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    if not n_all:
        return None
    often = np.zeros(len(vocabulary), np.int64)
    for term, df in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # as many as query terms
        often[term] = df
    weight = np.array([math.floor(1000 * math.log((2 * n_all + 2) / (2 * df + 1))) for df in often.tolist()], np.int64)
    asked = []
    for q in range(len(queries)):
        terms, repeats = np.unique(number[of == q], return_counts=True)
        weights = repeats * weight[terms]
        asked.append((terms[weights > 0], weights[weights > 0]))

    def run(batches):
        best = [Best(k) for _ in asked]
        for chunk in chunks(batches, n_all, length):
            for (terms, weights), held in zip(asked, best, strict=True):
                chunk.search(terms, weights, held)
        for q, held in enumerate(best):
            if len(held.ids):
                doc = pa.array(held.ids, pa.int64(), mask=held.ids == LAST)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held.ids), q, np.int32)), doc, pa.array(held.scores)], ["query", "doc_id", "score"])

    found = counts.mapInArrow(run, FOUND)
    first = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(queries)], "query int, item_id long")
    return scratch.save(ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"), f"ranked-{name}")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """`item_id, rank, doc_id, score`: the `k` best documents of every query, scores above 0."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    items = items.groupBy("item_id").agg(F.min("text").alias("text"))
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // QUERIES_AT_ONCE), -(-size // QUERY_BYTES))
    out = None
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        found = _block(docs, [(r.item_id, r.text) for r in block], k, scratch, str(b))
        out = found if out is None else out if found is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
