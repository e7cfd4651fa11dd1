"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed the way the 1978 dictionary compressor does: the longest phrase
met before, and one byte more, is the next phrase. Every phrase is new, so the
phrases are a set; texts that compress well together share many. The set is
hashed phrase by phrase and kept as a minimum-hash signature of `SIZE` values; the
likeness of two fingerprints is the share of equal values.

`neighbour_fingerprints` compares each text with the next one and with an edited
form of itself (its last quarter replaced from the next text). An edited text
shares its parse up to the edit, so that part is parsed once. The order by id is
global: documents are dealt into ranges of ids, and the first document of a range
is also sent, as a guest, to the range before. One shuffle carries the texts; the
driver sees ids of range boundaries only.

Null and empty texts have no phrases: their likeness is 1 to each other and 0 to
any other text. Null ids come first in the order, rows of one id in the order of
their texts. A single row is its own next one. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_POWERS, U64, mix, partitions, range_of, rows_of, spans_hash, texts

SIZE, CHUNK = 64, 1024
_A = (mix(np.arange(1, SIZE + 1, dtype=U64)) >> U64(32)).astype(np.uint32)[:, None] | np.uint32(1)
_B = (mix(np.arange(SIZE + 1, 2 * SIZE + 1, dtype=U64)) >> U64(32)).astype(np.uint32)[:, None]
NULL_ID = -(1 << 63)
COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class Parse:
    """The phrases of a text that comes in parts. A trie of nested dictionaries has a node for each phrase."""

    def __init__(self):
        self.root: dict = {}
        self.node, self.at = self.root, 0
        self.ends: list[int] = [0]  # code points

    def feed(self, text: str) -> None:
        root, node, end = self.root, self.node, self.ends.append
        for i, c in enumerate(text, self.at + 1):
            to = node.get(c)
            if to is None:
                node[c] = {}
                node = root
                end(i)
            else:
                node = to
        self.node, self.at = node, self.at + len(text)

    def peek(self, text: str) -> list[int]:
        """The ends of the phrases that `text` would add; nothing is kept of them."""
        root, node, made, ends = self.root, self.node, [], []
        for i, c in enumerate(text, self.at + 1):
            to = node.get(c)
            if to is None:
                node[c] = {}
                made.append((node, c))
                node = root
                ends.append(i)
            else:
                node = to
        for node, c in reversed(made):
            del node[c]
        return ends


def signature(text: str, ends: list[int]) -> np.ndarray:
    """Minimum hashes of the phrases of `text` between consecutive `ends`."""
    out = np.full(SIZE, 0xFFFFFFFF, np.uint32)
    if len(ends) > 1:
        places = np.array(ends)
        points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(U64) + U64(1)
        hashes = (spans_hash(points, places[:-1], places[1:], BYTE_POWERS) >> U64(32)).astype(np.uint32)
        for k in range(0, len(hashes), CHUNK):
            np.minimum(out, (hashes[k : k + CHUNK] * _A + _B).min(axis=1), out=out)
    return out


def written(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def fingerprint(text: str) -> np.ndarray:
    p = Parse()
    p.feed(text)
    return signature(text, p.ends)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


class _Document:
    """A text, parsed as far as its edit; the rest is looked ahead at twice."""

    def __init__(self, doc: int, data: bytes):
        self.doc, self.text, self.parse = doc, data.decode("utf-8", "replace"), Parse()
        self.cut = len(self.text) // 4
        self.head = self.text[: len(self.text) - self.cut]
        self.parse.feed(self.head)
        self.shared = signature(self.head, self.parse.ends)
        self.own = self.whole(self.text)

    def whole(self, text: str) -> np.ndarray:
        """The fingerprint of `text`, which begins with `head`."""
        last = self.parse.ends[-1]  # the phrase that crosses the cut begins here
        ends = [0, *(e - last for e in self.parse.peek(text[len(self.head) :]))]
        return np.minimum(self.shared, signature(text[last:], ends))

    def row(self, after: "_Document") -> tuple:
        edited = self.head + after.text[: self.cut]
        other = self.whole(edited)
        return (None if self.doc == NULL_ID else self.doc, len(self.text), hashlib.sha256(edited.encode()).hexdigest(), written(self.own), written(other), likeness(self.own, other), likeness(self.own, after.own))


def _neighbours(batches):
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    last, last_range, closed = None, None, False
    for keys, ranges, guests, data in rows_of(batches, "key", "range", "guest", "text"):
        out = []
        for key, part, guest, text in zip(keys, ranges, guests, data, strict=True):
            if part != last_range:
                last, last_range, closed = None, part, False
            if closed:  # more rows with the id of the guest
                continue
            document = _Document(key, text)
            if last is not None:
                out.append(last.row(document))
            last, closed = document, guest
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """COLUMNS for every document."""
    n = partitions(docs.sparkSession)
    rows = texts(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = sorted({int(x) for x in rows.approxQuantile("key", [i / n for i in range(1, n)], 0.2 / n)}) if n > 1 else []
    rows = rows.withColumn("range", range_of(F.col("key"), [F.lit(c) for c in cuts]))
    firsts = dict(sorted((r["range"], r["first"]) for r in rows.groupBy("range").agg(F.min("key").alias("first")).collect()))  # a row for each range
    # By range: its first key, and the range before it that has rows (before the first range, the last one).
    filled = list(firsts)
    before = {r: filled[k - 1] for k, r in enumerate(filled)}
    of_range = lambda values, none: F.get(F.array(*(F.lit(values.get(r, none)) for r in range(len(cuts) + 1))), F.col("range"))
    own = lambda p, g: F.struct(p.cast("int").alias("range"), F.lit(g).alias("guest"))
    here = own(F.col("range"), False)
    places = F.when(F.col("key") == of_range(firsts, None).cast("long"), F.array(here, own(of_range(before, 0), True))).otherwise(F.array(here))
    dealt = rows.select("key", "text", F.explode(places).alias("place")).select("key", "place.range", "place.guest", "text")
    return dealt.repartitionById(n, F.col("range")).sortWithinPartitions("range", "guest", "key", "text").mapInArrow(_neighbours, COLUMNS)
