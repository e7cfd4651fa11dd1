"""Helpers shared by the operators of this folder.

Texts travel to Python as Arrow batches and are handled as UTF-8 bytes, a few
documents at a time. Words are the runs `[^\\x20\\x09-\\x0D]+`, which is what
`bytes.split()` gives. Numeric work on the words of one document is numpy over
the whole document: a polynomial hash from prefix sums gives every word, every
shingle and every window a 64-bit hash without a Python loop.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_AT_ONCE = 256
U64 = np.uint64
IS_SPACE = np.zeros(256, np.int8)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = 1
CONTINUATION = bytes(range(0x80, 0xC0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id long, text string` only, so that no other column travels."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`. Where it is unset, a fresh one if all runs on this machine (tests); a cluster must name one."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        d = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", d)
    return on_default_file_system(spark, d.rstrip("/"))


def on_default_file_system(spark: SparkSession, folder: str) -> str:
    """The folder's full URI; one without a scheme is on Spark's default file system, as for Spark's own readers."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return folder if "://" in folder else path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().replace("file:/", "file:///", 1).replace("file:////", "file:///", 1)


class Scratch:
    """Written tables in a new folder below the shared one.

    `save` cuts the lineage: the table is on storage that outlives executors.
    `drop` removes a table that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.dir = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.dir}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.dir}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[list, ...]]:
    """Lists of the named columns, `ROWS_AT_ONCE` rows at a time; strings as bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            columns = (part.column(batch.schema.get_field_index(n)) for n in names)
            yield tuple((c.cast(pa.binary()) if pa.types.is_string(c.type) else c).to_pylist() for c in columns)


def broadcast_if_small(df: DataFrame, rows: int, most_rows: int) -> DataFrame:
    """A broadcast hint where the counted rows are within the bound, else nothing."""
    return F.broadcast(df) if rows <= most_rows else df


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def range_of(key: Column, cuts: list[Column]) -> Column:
    """How many of the literals `cuts` (ascending) are not above `key`: a binary search, one expression at any number of cuts."""
    if not cuts:
        return F.lit(0)
    table = F.array(*cuts)
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= key, at + step).otherwise(at))


def carried(docs: DataFrame, function, added: str, text_col: str = "text") -> DataFrame:
    """`docs` with the columns `added` ("name type, ..."), from `function(list of texts as bytes or None)`,
    which gives an Arrow array for each. All columns go along, so nothing is joined by id."""
    names = [x.split()[0] for x in added.split(", ")]
    clear = docs.drop(*names)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                text = part.column(part.schema.get_field_index(text_col))
                arrays = function(text.cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], [*part.schema.names, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clear.schema)
    return clear.mapInArrow(run, f"{schema}, {added}")


# ------------------------------------------------------------------ hashing

BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits (the splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Powers:
    """base**i and base**-i modulo 2**64, as far as the longest text so far."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = 1 << max(12, (n - 1).bit_length())
            self.up, self.down = (np.concatenate([np.ones(1, U64), np.full(m - 1, b, U64)]).cumprod(dtype=U64) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


BYTE_POWERS, WORD_POWERS, SECOND_POWERS = Powers(BYTE_BASE), Powers(WORD_BASE), Powers(0xAEF17502108EF2D9)


def prefix_sums(values: np.ndarray, powers: Powers) -> np.ndarray:
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(len(values) + 1)[0][:-1], out=sums[1:])
    return sums


def hashes_between(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """A hash of each `values[start:end]`, from their `prefix_sums`; equal contents, equal hashes."""
    down = powers(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    return hashes_between(prefix_sums(values, powers), starts, ends, powers)


def word_spans(data: bytes, between: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which words start and end. between: 1 for the bytes between words."""
    space = np.ones(len(data) + 2, np.int8)
    space[1:-1] = between[np.frombuffer(data, np.uint8)]
    turn = np.diff(space)
    return np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)


def word_hashes(data: bytes, spans: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    starts, ends = spans or word_spans(data)
    if not len(starts):
        return np.zeros(0, U64)
    return spans_hash(np.frombuffer(data, np.uint8).astype(U64) + U64(1), starts, ends, BYTE_POWERS)


def window_hashes(words: np.ndarray, size: int, powers: Powers = WORD_POWERS) -> np.ndarray:
    """A hash of each `size` consecutive words; none where the text is shorter."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    starts = np.arange(n)
    return spans_hash(words, starts, starts + size, powers)
