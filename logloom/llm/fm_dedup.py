"""Substring dedup: repeated windows found by compressed FM-indexes over shards.

A window is `WINDOW` consecutive words. A word goes if it lies in a window that
also starts in a document with a smaller id.

1. Documents of one word sequence form a class; its smallest id stands for it. In
   the others every window is a repeat, and nothing more need be looked up.
2. Anchors: in every window the smallest hash of `GRAM` words is its anchor, so
   equal windows have equal anchors. Anchors met in one document only rule out
   their windows; most text goes no further.
3. The windows left are hashed and grouped: the smallest id among equal hashes is
   a window's source. Sums are partial, so no frequent window gathers in one task.
   Runs of windows in their source make up what is indexed, each repeated window
   once; runs of windows elsewhere are the queries, each addressed to its source.
4. Sources are dealt into shards of bounded size. A shard's index has the word
   numbers' Burrows-Wheeler transform in a pointerless wavelet tree of packed bits
   with rank counts. Queries stream past their shard's index, many at a time in
   step: backward search extends each match to the left one word a step; where it
   ends, it starts again at the end of the next window to the left. A window counts
   if its matching statistic reaches `WINDOW`, so the index decides, not the hash.
   Queries of one shard are salted into parts of bounded size, each with a copy of
   the shard's index.

Null and empty texts have no words. Null ids neither lose words nor are sources.
Rows that repeat an id are judged each by its own text and are no sources for one
another. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WORD_POWERS, Scratch, partitions, rows_of, texts, window_hashes, word_hashes

WINDOW, GRAM = 50, 16
SHARD_WORDS, QUERY_WORDS, PIECE, AT_ONCE = 1_000_000, 2_000_000, 200, 4_000


def windows(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    return window_hashes(hashes, window, WORD_POWERS)


def anchors(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The anchor of each window."""
    grams = window_hashes(hashes, gram, WORD_POWERS)
    n, width = len(hashes) - window + 1, window - gram + 1
    if n <= 0:
        return np.zeros(0, U64)
    least, have = grams, 1
    while 2 * have <= width:
        least, have = np.minimum(least[: len(least) - have], least[have:]), 2 * have
    return np.minimum(least[:n], least[width - have : width - have + n])


def runs(starts: np.ndarray, same: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(first, count) of consecutive `starts` in ascending order, with equal `same`."""
    if not len(starts):
        return []
    new = np.diff(starts) != 1
    if same is not None:
        new |= np.diff(same) != 0
    cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(starts)]])
    return [(int(starts[a]), int(b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


# ------------------------------------------------------------------ the index


class Bits:
    """Packed bits with a count before every 64 of them."""

    def __init__(self, words: np.ndarray, before: np.ndarray):
        self.words, self.before = words, before

    @classmethod
    def of(cls, bits: np.ndarray) -> "Bits":
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        words = np.packbits(padded, bitorder="little").view("<u8")
        return cls(words, np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.uint32))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, rest = at >> 6, (at & 63).astype(U64)
        inside = self.words[word] & ((U64(1) << rest) - U64(1))
        return self.before[word].astype(np.int64) + np.bitwise_count(inside)


class FMIndex:
    """Of a sequence of word hashes, runs parted by a number that no query has."""

    def __init__(self, vocabulary, first, begins, levels, zeros, size):
        self.vocabulary, self.first, self.begins = vocabulary, first, begins
        self.levels, self.zeros, self.size = levels, zeros, size

    @classmethod
    def build(cls, parts: list[np.ndarray]) -> "FMIndex":
        words = np.concatenate([x for p in parts for x in (p, np.zeros(1, U64))]) if parts else np.zeros(1, U64)
        is_gap = np.zeros(len(words), bool)
        is_gap[np.cumsum([len(p) + 1 for p in parts]) - 1] = True
        vocabulary = np.unique(words[~is_gap])
        numbers = np.searchsorted(vocabulary, words) + 1
        numbers[is_gap] = 0
        order = cls.suffixes(numbers)
        bwt = numbers[order - 1]  # the word before each suffix; the last one before the first
        counts = np.bincount(numbers, minlength=len(vocabulary) + 1)
        first = np.concatenate([[0], np.cumsum(counts)])[:-1]
        depth = max(1, int(len(vocabulary)).bit_length())
        levels, zeros = [], []
        for k in reversed(range(depth)):
            bits = (bwt >> k & 1).astype(np.uint8)
            levels.append(Bits.of(bits))
            zeros.append(int(len(bits) - bits.sum()))
            bwt = np.concatenate([bwt[bits == 0], bwt[bits == 1]])
        out = cls(vocabulary, first, None, levels, zeros, len(words))
        out.begins = out._down(np.arange(len(vocabulary) + 1), np.zeros(len(vocabulary) + 1, np.int64))
        return out

    @staticmethod
    def suffixes(numbers: np.ndarray) -> np.ndarray:
        """The suffix array, by doubling the length that ranks tell apart."""
        n, step = len(numbers), 1
        rank = np.unique(numbers, return_inverse=True)[1].astype(np.int64) + 1
        while True:
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] if step < n else after[:0]
            key = rank * (n + 2) + after
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            new = np.concatenate([[1], (ordered[1:] != ordered[:-1]).astype(np.int64)])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            if rank[order[-1]] == n:
                return order
            step *= 2

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places followed down the tree along the symbols' bits."""
        depth = len(self.levels)
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = bits.rank(at)
            at = np.where(symbols >> (depth - 1 - k) & 1, zeros + ones, at - ones)
        return at

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Numbers of words, 0 for those not in the index."""
        if not len(self.vocabulary):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + 1, 0)

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that start with a symbol and go on as those in [low, high)."""
        both = self._down(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        base = self.first[symbols] - self.begins[symbols]
        return base + both[: len(symbols)], base + both[len(symbols) :]

    def matched(self, queries: list[np.ndarray], window: int = WINDOW) -> list[np.ndarray]:
        """For each query, which of its windows the index holds, from matching statistics."""
        starts = np.concatenate([[0], np.cumsum([len(q) for q in queries])]).astype(np.int64)
        flat = self.symbols(np.concatenate(queries)) if queries else np.zeros(0, np.int64)
        found = np.zeros(len(flat), bool)
        begin, live = starts[:-1].copy(), np.flatnonzero(np.diff(starts) >= window)
        end = starts[1:].copy()  # where the present match ends
        at, low, high = end.copy(), np.zeros(len(queries), np.int64), np.full(len(queries), self.size, np.int64)
        while len(live):
            p = at[live] - 1
            symbol = flat[p]
            lo, hi = self.extend(symbol, low[live], high[live])
            good = (symbol > 0) & (lo < hi)
            # Extended by one word to the left.
            g = live[good]
            at[g], low[g], high[g] = p[good], lo[good], hi[good]
            full = g[end[g] - at[g] >= window]
            found[at[full]] = True
            # Ended: the match of the next window to the left starts at that window's end.
            b, q = live[~good], p[~good]
            again = np.where(end[b] > q + window, q + window, end[b] - 1)
            end[b] = at[b] = again
            low[b], high[b] = 0, self.size
            live = live[(at[live] > begin[live]) & (end[live] - begin[live] >= window)]
        return [found[s:e] for s, e in zip(starts[:-1], starts[1:], strict=True)]

    def pack(self) -> bytes:
        out = io.BytesIO()
        levels = {f"{n}{i}": x for i, b in enumerate(self.levels) for n, x in (("w", b.words), ("c", b.before))}
        np.savez(out, vocabulary=self.vocabulary, first=self.first, begins=self.begins, zeros=np.array(self.zeros), size=np.array(self.size), **levels)
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> "FMIndex":
        z = np.load(io.BytesIO(data))
        levels = [Bits(z[f"w{i}"], z[f"c{i}"]) for i in range(len(z["zeros"]))]
        return cls(z["vocabulary"], z["first"], z["begins"], levels, z["zeros"].tolist(), int(z["size"]))


# ------------------------------------------------------------------ the stages


def _measured(docs: DataFrame) -> DataFrame:
    """`doc_id, n_words, sha, anchors` of every row."""

    def run(batches):
        for ids, data in rows_of(batches, "doc_id", "text"):
            n, sha, found = [], [], []
            for x in data:
                words = (x or b"").split()
                n.append(len(words))
                sha.append(digest(words))
                found.append(np.unique(anchors(word_hashes(x))) if len(words) >= WINDOW else np.zeros(0, U64))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), lists], ["doc_id", "n_words", "sha", "anchors"])

    return docs.mapInArrow(run, "doc_id long, n_words long, sha string, anchors array<long>")


def tag(sha: str) -> int:
    """A number for a word sequence, that tells apart texts of one id."""
    return int(sha[:15], 16)


def _own_rows(batches, *names: str):
    """Rows of documents by (doc_id, tag), each with its words; rows of the id's other texts are left out."""
    for columns in rows_of(batches, "doc_id", "tag", "text", *names):
        for doc, key, text, *more in zip(*columns, strict=True):
            words = (text or b"").split()
            if tag(digest(words)) == key:
                yield doc, key, text, words, *more


def _blocks(rows, types: list, names: list[str], most: int = 20_000):
    """Record batches of `most` rows or a little more, from lists of column slices."""
    held, size = [], 0
    for columns in rows:
        held.append(columns)
        size += len(columns[0])
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(c, t) for c in col]) for col, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(c, t) for c in col]) for col, t in zip(zip(*held, strict=True), types, strict=True)], names)


def _windows(own: DataFrame) -> DataFrame:
    """`doc_id, tag, start, window` of the windows whose anchor is one of `anchors`."""

    def run(batches):
        def rows():
            for doc, key, text, _, some in _own_rows(batches, "anchors"):
                hashes = word_hashes(text)
                at = np.flatnonzero(np.isin(anchors(hashes).view(np.int64), np.array(some, np.int64)))
                yield np.full(len(at), doc), np.full(len(at), key), at.astype(np.int32), windows(hashes)[at].view(np.int64)

        yield from _blocks(rows(), [pa.int64(), pa.int64(), pa.int32(), pa.int64()], ["doc_id", "tag", "start", "window"])

    return own.select("doc_id", "tag", "text", "anchors").mapInArrow(run, "doc_id long, tag long, start int, window long")


def _runs(placed: DataFrame) -> DataFrame:
    """`source, doc_id, tag, start, count, words`: text of consecutive windows with one source.

    Those in the source itself are whole, others come in pieces. placed: own, and `places`."""

    def run(batches):
        def rows():
            for doc, key, _, words, places in _own_rows(batches, "places"):
                start = np.array([p["start"] for p in places], np.int64)
                source = np.array([p["source"] for p in places], np.int64)
                at = 0
                out = []
                for first, count in runs(start, source):
                    to = int(source[at])
                    at += count
                    size = count if to == doc else PIECE
                    out += [(to, doc, key, k, min(size, first + count - k), b" ".join(words[k : k + min(size, first + count - k) + WINDOW - 1])) for k in range(first, first + count, size)]
                if out:
                    yield list(zip(*out, strict=True))

        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for batch in _blocks(rows(), types, ["source", "doc_id", "tag", "start", "count", "words"], 2_000):
            yield batch.set_column(5, "words", batch.column(5).cast(pa.string()))

    return placed.select("doc_id", "tag", "text", "places").mapInArrow(run, "source long, doc_id long, tag long, start int, count int, words string")


def _indexes(parts: DataFrame) -> DataFrame:
    """`shard, index` from the runs in their sources; a shard's words are bounded."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        index = FMIndex.build([word_hashes(x.encode()) for x in pdf["words"]])
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "index": [index.pack()]})

    return parts.select("shard", "words").groupBy("shard").applyInPandas(build, "shard int, index binary")


def _searched(dealt: DataFrame) -> DataFrame:
    """`doc_id, tag, start, count`: runs of windows that the index holds. dealt: by shard and salt, the index first."""

    def search(index: FMIndex, held: list[tuple]) -> list[tuple]:
        found = index.matched([word_hashes(words) for *_, words in held])
        return [(doc, key, start + first, count) for (doc, key, start, _), hits in zip(held, found, strict=True) for first, count in runs(np.flatnonzero(hits))]

    def run(batches):
        index, held = None, []
        out: list[tuple] = []
        for columns in rows_of(batches, "index", "doc_id", "tag", "start", "words"):
            for blob, doc, key, start, words in zip(*columns, strict=True):
                if blob is not None:
                    out += search(index, held) if held else []
                    index, held = FMIndex.unpack(blob), []
                    continue
                held.append((doc, key, start, words))
                if len(held) >= AT_ONCE:
                    out, held = out + search(index, held), []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "tag", "start", "count"])
                out = []
        if held and (out := search(index, held)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "tag", "start", "count"])

    return dealt.select("index", "doc_id", "tag", "start", "words").mapInArrow(run, "doc_id long, tag long, start int, count int")


def _cut(hit: DataFrame) -> DataFrame:
    """`doc_id, tag, n_removed, kept_sha256` of documents with `hits`."""

    def run(batches):
        rows = []
        for doc, key, _, words, hits in _own_rows(batches, "hits"):
            gone = np.zeros(len(words) + 1, np.int32)
            for h in hits:
                gone[h["start"]] += 1
                gone[h["start"] + h["count"] + WINDOW - 1] -= 1
            left = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
            rows.append((doc, key, len(words) - len(left), digest([words[i] for i in left])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "tag", "n_removed", "kept_sha256"])

    return hit.select("doc_id", "tag", "text", "hits").mapInArrow(run, "doc_id long, tag long, n_removed long, kept_sha256 string")


def repeated_windows(own: DataFrame, scratch: Scratch) -> DataFrame:
    """`doc_id, tag, start, count`: runs of windows that start in a document with a smaller id, too.

    own: `doc_id, tag, anchors, text` of documents with shared anchors."""
    spark = own.sparkSession
    found = _windows(own)
    sources = found.groupBy("window").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("source < last").select("window", "source")
    places = found.join(sources, "window").groupBy("doc_id", "tag").agg(F.array_sort(F.collect_list(F.struct("start", "source"))).alias("places"))  # of one text
    marked = scratch.save(_runs(own.select("doc_id", "tag", "text").join(places, ["doc_id", "tag"])), "runs")
    inside = F.col("source") == F.col("doc_id")
    n_words = F.col("count") + F.lit(WINDOW - 1)
    shards = max(1, -(-(marked.where(inside).agg(F.sum(n_words)).first()[0] or 0) // SHARD_WORDS))
    marked = marked.withColumn("shard", F.pmod(F.xxhash64("source"), F.lit(shards)).cast("int"))
    indexes = scratch.save(_indexes(marked.where(inside)), "indexes")
    queries = marked.where(~inside)
    salts = queries.groupBy("shard").agg(F.ceil(F.sum(n_words) / F.lit(QUERY_WORDS)).cast("int").alias("salts"))
    heads = indexes.join(salts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "index", *(F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("tag", "long"), ("start", "int"), ("words", "string"))))
    asked = queries.join(salts, "shard").select("shard", F.pmod(F.xxhash64("doc_id", "start"), F.col("salts")).cast("int").alias("salt"), F.lit(None).cast("binary").alias("index"), "doc_id", "tag", "start", "words")
    dealt = heads.unionByName(asked).repartition(partitions(spark), "shard", "salt").sortWithinPartitions("shard", "salt", F.col("doc_id").asc_nulls_first())
    return _searched(dealt)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, n_words, n_removed, kept_sha256, removed_windows` for every row. The last
    holds the runs (start, count) of repeated windows; null where the whole text repeats."""
    scratch = Scratch(docs.sparkSession, "fm")
    rows = texts(docs, id_col, text_col)
    every = scratch.save(_measured(rows), "measured")
    long_ones = every.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= WINDOW))
    number = F.conv(F.substring("sha", 1, 15), 16, 10).cast("long").alias("tag")
    reps = scratch.save(long_ones.groupBy("sha").agg(F.min("doc_id").alias("rep"), F.min_by("anchors", "doc_id").alias("anchors")).select("sha", "rep", number, "anchors"), "classes")
    each = reps.select(F.col("rep").alias("doc_id"), "tag", F.explode("anchors").alias("anchor"))
    shared = each.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    wanted = each.join(shared, "anchor").groupBy("doc_id", "tag").agg(F.collect_set("anchor").alias("anchors"))  # of one text
    own = scratch.save(wanted.join(rows.where("doc_id IS NOT NULL"), "doc_id"), "own")
    hits = repeated_windows(own, scratch).groupBy("doc_id", "tag").agg(F.array_sort(F.collect_list(F.struct("start", "count"))).alias("hits"))  # of one text
    hits = scratch.save(hits, "hits")
    cut = _cut(own.select("doc_id", "tag", "text").join(hits, ["doc_id", "tag"])).dropDuplicates(["doc_id", "tag"]).join(hits, ["doc_id", "tag"])
    cut = cut.select(F.col("doc_id").alias("rep"), "tag", "n_removed", "kept_sha256", "hits")
    known = reps.select("sha", "rep", "tag").join(cut, ["rep", "tag"], "left")
    copied = F.col("rep") < F.col("doc_id")
    out = every.select("doc_id", "n_words", "sha").join(known, "sha", "left")
    return out.select(
        "doc_id", "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.coalesce("n_removed", F.lit(0)))).cast("long").alias("n_removed"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.when(F.col("doc_id").isNull(), F.col("sha")).otherwise(F.coalesce("kept_sha256", "sha"))).alias("kept_sha256"),
        F.when(F.col("doc_id").isNull() | (~copied & F.col("hits").isNull()) | copied.isNull(), F.array().cast("array<struct<start:int,count:int>>")).when(copied, None).otherwise(F.col("hits")).alias("removed_windows"),
    )
