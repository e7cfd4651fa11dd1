"""Quality rules: line-first cleaning.

Every line that has a word is judged by itself; failing lines go, and a document
that loses too many of its words with them is rejected. The line rules, each on a
line of `w` words (fixed values below):

* navigation: at least two `|`, and one for every four words;
* symbols: a tenth of the characters or more are of `[#*$%&|<>]`;
* shouting: at least two `!!`, and one for every three words;
* boilerplate: at most `BOILERPLATE_WORDS` words, with one of `BOILERPLATE`;
* punctuation: `SENTENCE_WORDS` words or more with no closing mark at the end.

Besides, a document of fewer than ten words, or with over a fifth of its words in
repeated 5-word windows, fails outright. Everything is counted over whole texts,
in one pass without a shuffle.

Null and empty texts have no words and fail. Null ids stay null; repeated rows
and ties are judged each by itself; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CONTINUATION, ROWS_AT_ONCE, U64, rows_of, texts

SPACES, SYMBOLS = b"\x20\x09\x0a\x0b\x0c\x0d", b"#*$%&|<>"
# Fixed values of the line rules.
BOILERPLATE = ("all rights reserved", "terms of service", "terms of use", "privacy policy", "cookie policy", "lorem ipsum", "enable javascript", "click here", "subscribe to our newsletter", "powered by")
BOILERPLATE_WORDS, SENTENCE_WORDS = 30, 8
CLOSING = (".", "!", "?", ":", ";", '"', "'", ")", "]", "»", "”", "’", "…", "。", "！", "？")
MOST_LOST = 0.5

_BOILERPLATE = tuple(x.encode() for x in BOILERPLATE)
_CLOSING = tuple(x.encode() for x in CLOSING)
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], U64)

COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_lines_removed long, n_words_removed long, clean_text string"


def chars(data: bytes) -> int:
    """Code points."""
    return len(data.translate(None, CONTINUATION))


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words that lie in a window of `size` words found at least twice."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(U64)
    windows = sum(hashes[i : i + n] * _K[i] for i in range(size))
    ordered = np.sort(windows)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    at = np.flatnonzero(np.isin(windows, again)).tolist()
    found = Counter(tuple(words[i : i + size]) for i in at)  # the words themselves decide
    covered = np.zeros(len(words) + 1, np.int64)
    for i in at:
        if found[tuple(words[i : i + size])] > 1:
            covered[i] += 1
            covered[i + size] -= 1
    return int((np.cumsum(covered) > 0).sum())


def line_fails(line: bytes, n_words: int) -> bool:
    pipes, shouts = line.count(b"|"), line.count(b"!!")
    if pipes >= 2 and 4 * pipes >= n_words or shouts >= 2 and 3 * shouts >= n_words:
        return True
    if 10 * (len(line) - len(line.translate(None, SYMBOLS))) >= chars(line):
        return True
    if n_words >= SENTENCE_WORDS and not line.rstrip().endswith(_CLOSING):
        return True
    if n_words <= BOILERPLATE_WORDS:
        low = line.lower()  # bytes: A-Z only
        return any(x in low for x in _BOILERPLATE)
    return False


def judge(data: bytes) -> tuple:
    """The values of COLUMNS but the id, of one text."""
    words = data.split()
    seen: set[bytes] = set()
    left, n_lines, n_dup, n_removed, lost = [], 0, 0, 0, 0
    for line in data.split(b"\n"):
        n = len(line.split())
        if not n:
            left.append(line)
            continue
        n_lines += 1
        n_dup += line in seen
        seen.add(line)
        if line_fails(line, n):
            n_removed, lost = n_removed + 1, lost + n
        else:
            left.append(line)
    clean = data if not n_removed else b"\n".join(left)
    return len(words), chars(data.translate(None, SPACES)), len(data) - len(data.translate(None, SYMBOLS)), n_dup, repeated_words(words), n_lines, n_removed, lost, clean


def _judged(batches):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    for ids, data in rows_of(batches, "doc_id", "text"):
        columns = list(zip(*(judge(x or b"") for x in data), strict=True))
        arrays = [pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, names)


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_lost: float = MOST_LOST) -> DataFrame:
    """COLUMNS, `base_failed` and `kept` for every document; `clean_text` is the text
    without its failing lines."""
    n, repeated, lost = F.col("n_words"), F.col("n_repeat_words"), F.col("n_words_removed")
    failed = (n < 10) | (100 * repeated > 20 * n)
    return (texts(docs, id_col, text_col).mapInArrow(_judged, COLUMNS)
            .withColumn("base_failed", failed)
            .withColumn("kept", ~failed & (lost <= most_lost * n)))


def keep_clean(docs: DataFrame, most_lost: float = MOST_LOST) -> DataFrame:
    """Kept documents with their cleaned text and its length, other columns as they are.

    Everything is carried through one pass: the row's other columns go along, so no
    join by id is needed.
    """
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)

    def clean(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                named = dict(zip(batch.schema.names, batch.columns, strict=True))
                results = [judge(x or b"") for x in named["text"].cast(pa.binary()).to_pylist()]
                keep = [not (r[0] < 10 or 100 * r[4] > 20 * r[0]) and r[7] <= most_lost * r[0] for r in results]
                text = pa.array([r[-1] for r in results], pa.binary()).cast(pa.string())
                out = pa.RecordBatch.from_arrays([*(named[c] for c in others), text], [*others, "text"])
                yield out.filter(pa.array(keep, pa.bool_()))

    cleaned = docs.select(*others, F.col("text").cast("string").alias("text")).mapInArrow(clean, f"{schema}, text string" if others else "text string")
    values = {c: F.length("text").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns}
    return cleaned.select(*(v.alias(c) for c, v in values.items()))
