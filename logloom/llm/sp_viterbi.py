"""SentencePiece encoding and decoding by streaming Viterbi.

The best segmentation of a text is the sequence of vocabulary pieces with the
greatest sum of scores. Going over the characters, only boundaries within the
longest piece's length can still be left by a piece, so no more scores are held.
Each boundary points back to the one before; when the paths from all boundaries
still held meet in one boundary, the ids up to it are final: they are handed out
and forgotten. A text may thus be of any length.

Some places are boundaries of every path, whatever follows: between two
characters that stand side by side in no piece. With the usual vocabularies these
are the places before a space mark and around characters without a piece. The
text is cut there by a pattern, and the ids of short cuts met before come from a
bounded table in each worker.

A vocabulary made by merges gives each piece its merge's rank in place of a score.
Ranks follow frequency, so such pieces get the logarithm of a Zipf-Mandelbrot
frequency, 1 / (rank + ZIPF_SHIFT): a fixed rule, nothing is fitted. Scores of other
vocabularies are taken as they are. Paths are looked at for a common boundary once in
twice the longest piece's characters.

A text gets a leading space; spaces are written as U+2581. A character that is no
piece is written as its UTF-8 bytes, and so is U+2581 itself where the text has
it, so decoding gives back every text exactly. Ties go to the longer last piece.

Null and empty texts have no ids. Null ids of documents stay null; repeated rows
are encoded as often as they come; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, texts

MARK, UNKNOWN_COST, CACHED, PREFIX = "▁", 10.0, 600_000, ()
ZIPF_SHIFT = 100.0
COLUMNS = "doc_id long, n_chars long, n_tokens long, ids_crc32 long, round_trip boolean"
ENCODED = "doc_id long, ids array<int>"


class Pieces:
    """A vocabulary: pieces with scores, and one id for each byte."""

    def __init__(self, pieces: list[tuple[str, float, int]], byte_ids: list[int]):
        self.score = {p: (s, (i,)) for p, s, i in pieces}
        #: Pieces and what pieces begin with: a look ahead ends at the first text that is neither.
        self.prefixes = {p[:k]: PREFIX for p in self.score for k in range(1, len(p))} | self.score
        self.byte_ids, self.longest = byte_ids, max(len(p) for p in self.score)
        self.unknown = min((s for s, _ in self.score.values()), default=0.0) - UNKNOWN_COST
        self.text = {i: p.replace(MARK, " ").encode() for p, _, i in pieces} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
        self.mark_bytes = [byte_ids[b] for b in MARK.encode()]
        inner = any(MARK in p.lstrip(MARK) for p in self.score)
        lone = "\n" if not any("\n" in p for p in self.score) else ""
        #: Cuts at places that every path goes through; without any, whole texts.
        self.cuts = re.compile(r"(?s).+" if inner else rf" *[^ {lone}]+|{lone or '(?!)'}| +")
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def load(cls, model_file: str) -> "Pieces":
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = range(m.get_piece_size())
        plain = [(m.id_to_piece(i), m.get_score(i), i) for i in n if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        if all(s == int(s) for _, s, _ in plain):
            plain = [(p, -math.log(ZIPF_SHIFT - s), i) for p, s, i in plain]
        return cls(plain, [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    def stream(self, text: str) -> Iterator[list[int]]:
        """Ids of `text` (with space marks) in final runs, as soon as they are final."""
        lookup, unknown, n, check = self.prefixes.get, self.unknown, len(text), 2 * self.longest
        best = {0: 0.0}  # scores of the boundaries that no piece has left yet
        back: dict[int, tuple[int, object]] = {}  # of those whose ids are not final
        done = 0
        for start in range(n):
            if start and start % check == 0:
                held = set(best)
                while len(held) > 1:
                    held.remove(x := max(held))
                    held.add(back[x][0])
                meet = held.pop()
                if meet > done:
                    yield self._path(back, done, meet)
                    for x in [x for x in back if x <= meet]:
                        del back[x]
                    done = meet
            score, end = best.pop(start), start + 1
            found = lookup(text[start])
            if found is None or found is PREFIX:
                if score + unknown > best.get(end, -1e300):
                    best[end], back[end] = score + unknown, (start, tuple(self.byte_ids[b] for b in text[start].encode()))
            while found is not None:
                if found is not PREFIX and score + found[0] > best.get(end, -1e300):
                    best[end], back[end] = score + found[0], (start, found[1])
                end += 1
                if end > n:
                    break
                found = lookup(text[start:end])
        if n > done:
            yield self._path(back, done, n)

    @staticmethod
    def _path(back, start: int, end: int) -> list[int]:
        runs = []
        while end > start:
            end, ids = back[end]
            runs.append(ids)
        return [i for ids in reversed(runs) for i in ids]

    def _cut(self, cut: str) -> bytes:
        found = self.old.get(cut)
        if found is None:
            found = np.array([i for run in self.stream(cut.replace(" ", MARK)) for i in run], "<i4").tobytes()
        if len(cut) <= 48:
            if len(self.new) >= CACHED:  # the table before stays for another round
                self.old, self.new = self.new, {}
            self.new[cut] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<i4")
        out, get, cut = [], self.new.get, self._cut
        for k, part in enumerate((" " + text).split(MARK)):
            if k:
                out.append(np.array(self.mark_bytes, "<i4").tobytes())
            get = self.new.get
            for x in self.cuts.findall(part):
                ids = get(x)
                if ids is None:
                    ids, get = cut(x), self.new.get
                out.append(ids)
        return np.frombuffer(b"".join(out), "<i4")

    def decode(self, ids) -> bytes:
        return b"".join(map(self.text.__getitem__, ids))[1:]


@lru_cache(2)
def pieces(model_file: str) -> Pieces:
    return Pieces.load(model_file)


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ENCODED for every document. `model_file` is the model's path on every machine."""

    def run(batches):
        p = pieces(model_file)
        for ids, data in rows_of(batches, "doc_id", "text"):
            found = [p.encode((x or b"").decode("utf-8", "replace")) for x in data]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], ["doc_id", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """`doc_id, text` of ENCODED rows; null ids give an empty text."""

    def run(batches):
        p = pieces(model_file)
        for docs, ids in rows_of(batches, "doc_id", "ids"):
            text = pa.array([p.decode(x or []) for x in ids], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), text], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def encoded_digest(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """COLUMNS: counts and checksum of the ids (as little-endian 32-bit integers), and
    whether decoding them gives the text back."""

    def run(batches):
        p = pieces(model_file)
        for ids, data in rows_of(batches, "doc_id", "text"):
            rows = []
            for x in data:
                text = (x or b"").decode("utf-8", "replace")
                found = p.encode(text)
                rows.append((len(text), len(found), zlib.crc32(found.tobytes()), p.decode(found.tolist()) == text.encode()))
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in COLUMNS.split(", ")])

    return texts(docs, id_col, text_col).mapInArrow(run, COLUMNS)
