"""Token ids in flat binary files.

A data set is a folder of shards. `<shard>.ids` holds token ids and nothing else,
as little-endian unsigned integers (16 bits where the vocabulary fits, else 32);
`<shard>.docs` holds pairs of little-endian 64-bit integers, one pair for each
document: its id and the offset just past its last token in the shard. Shards
follow each other in ascending document id. A manifest (Parquet) has one row for
each shard: its place, name, counts and `base`, the number of tokens in all
shards before it, a prefix sum over the shards.

Tasks sort a range of ids, encode it and write as they go, so that no task holds
its shard. Files are named after the task attempt, and only the attempt that
Spark counts gets into the manifest: a lost or repeated task leaves a file that
nothing names. The reader memory-maps the files where the folder is mounted and
otherwise reads ranges of them.

Encoding goes run by run where the tokenizer's file says that it drops white space
and that its patterns, normalisation and merges never cross it (`drops_space`): a
text's ids are then those of its runs between ASCII white space, one after the
other, and runs met before come from a bounded table in each worker. Other
tokenizers encode whole texts. `word_parts` overrides the choice.

Null texts count as empty and hold only the end id. Null document ids sort first
and are read back as null. Repeated rows are written as often as they come, in
ascending order of id and then text. Other columns are ignored. An empty table
gives no shard and no row.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import on_default_file_system, partitions, rows_of, shared_dir, texts

CACHED_RUNS, BLOCK = 1_000_000, 1 << 20
NULL_ID = -(1 << 63)
SHARD = "place int, shard string, n_docs long, n_tokens long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


# The pattern of the tokenizers whose pieces never hold white space, and the letters for which it reads
# the same below (ASCII and the Latin-1 letters, which lower one to one and are composed already).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = re.compile("[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
PLAIN_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\\sa-z0-9\xdf-\xf6\xf8-\xff]+")


def drops_space(tokenizer_file: str) -> bool:
    """Whether the tokenizer lowers text and cuts it by PIECES, bytes within, and does nothing else before its model."""
    with open(tokenizer_file, encoding="utf-8") as f:
        told = json.load(f)
    before = (told.get("normalizer") or {}).get("normalizers") or []
    cuts = (told.get("pre_tokenizer") or {}).get("pretokenizers") or []
    lowers = [x.get("type") for x in before] == ["NFC", "Replace", "Lowercase"] and (before[1].get("pattern"), before[1].get("content")) == ({"Regex": r"\s+"}, " ")
    cut = len(cuts) == 2 and cuts[0].get("type") == "Split" and cuts[0].get("pattern") == {"Regex": PIECES} and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert")
    plain = cut and cuts[1].get("type") == "ByteLevel" and not cuts[1].get("add_prefix_space") and not cuts[1].get("use_regex", True)
    return bool(lowers and plain and told["model"].get("type") == "BPE" and not told["model"].get("dropout"))


class Kept(dict):
    """What `make` gives for a key, kept for keys met lately: two generations of bounded size."""

    def __init__(self, make, most: int = CACHED_RUNS):
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, key):
        if len(self) >= self.most // 2:
            self.before = dict(self)
            self.clear()
        out = self.before.get(key)
        if out is None:
            out = self.make(key)
        if len(key) <= 64:
            self[key] = out
        return out


class RunIds(Kept):
    """Bytes of the ids of each run between white space.

    Runs of plain letters, digits and marks are cut into pieces here, and the model alone is asked for pieces not met
    before; the tokenizer does all others."""

    def __init__(self, tokenizer, kind: str, plain: bool):
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__(self.ids)
        self.tokenizer, self.kind, self.plain = tokenizer, kind, plain
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.spelled = ByteLevel(add_prefix_space=False, use_regex=False)
        self.pieces = Kept(self.piece)

    def piece(self, piece: str) -> bytes:
        ((spelling, _),) = self.spelled.pre_tokenize_str(piece)
        return np.array([t.id for t in self.tokenizer.model.tokenize(spelling)], self.kind).tobytes()

    def ids(self, run: bytes) -> bytes:
        text = run.decode("utf-8", "replace")
        if self.plain and PLAIN.fullmatch(text) and not any(x in text for x in self.special):
            return b"".join(map(self.pieces.__getitem__, PLAIN_PIECES.findall(text.lower())))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()


@lru_cache(2)
def run_ids(tokenizer_file: str, kind: str) -> RunIds:
    from tokenizers import Tokenizer

    return RunIds(Tokenizer.from_file(tokenizer_file), kind, drops_space(tokenizer_file))


def _open(folder: str):
    return pafs.FileSystem.from_uri(folder)


def write_shards(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int, vocabulary: int, shards: int, word_parts: bool) -> DataFrame:
    """Write the files of `docs` (doc_id, text); gives SHARD, a row for each file."""
    kind = "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"

    def write(batches):
        fs, root = _open(folder)
        runs = run_ids(tokenizer_file, kind)
        end, width = np.array([end_id], kind).tobytes(), np.dtype(kind).itemsize
        task = TaskContext.get()
        shard = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        n_docs = n_tokens = 0
        ids_file = docs_file = None
        for ids, data in rows_of(batches, "doc_id", "text"):
            if ids_file is None:
                fs.create_dir(root, recursive=True)
                ids_file, docs_file = (fs.open_output_stream(f"{root}/{shard}.{x}") for x in ("ids", "docs"))
            parts, index = [], np.empty((len(ids), 2), "<i8")
            for k, (doc, text) in enumerate(zip(ids, data, strict=True)):
                if word_parts:
                    found = b"".join(map(runs.__getitem__, (text or b"").split()))
                else:
                    found = np.array(runs.tokenizer.encode((text or b"").decode("utf-8", "replace"), add_special_tokens=False).ids, kind).tobytes()
                parts += found, end
                n_tokens += len(found) // width + 1
                index[k] = NULL_ID if doc is None else doc, n_tokens
            ids_file.write(b"".join(parts))
            docs_file.write(index.tobytes())
            n_docs += len(ids)
        if ids_file is not None:
            ids_file.close()
            docs_file.close()
            arrays = [[task.partitionId()], [shard], [n_docs], [n_tokens]]
            yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["place", "shard", "n_docs", "n_tokens"])

    ordered = docs.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return ordered.mapInArrow(write, SHARD)


def _documents(fs, root: str, shard: str, base: int, n_docs: int, n_tokens: int, kind: str):
    """Per block of documents: READ's columns, from the files."""
    width = np.dtype(kind).itemsize

    def mapped(name: str):
        if isinstance(fs, pafs.LocalFileSystem):
            return pa.memory_map(name)
        return fs.open_input_file(name)

    with mapped(f"{root}/{shard}.docs") as f:
        index = np.frombuffer(f.read(16 * n_docs), "<i8").reshape(-1, 2)
    if len(index) != n_docs or index[-1, 1] != n_tokens:
        raise OSError(f"{shard}.docs does not hold the {n_docs} documents of the manifest")
    ends = index[:, 1]
    starts = np.concatenate([[0], ends[:-1]])
    with mapped(f"{root}/{shard}.ids") as f:
        at = 0
        while at < n_docs:
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
            ids = np.frombuffer(f.read_at(int(ends[to - 1] - starts[at]) * width, int(starts[at]) * width), kind)
            wide = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(wide[4 * (s - starts[at]) : 4 * (e - starts[at])]) for s, e in zip(starts[at:to], ends[at:to], strict=True)]
            yield index[at:to, 0], base + starts[at:to], ends[at:to] - starts[at:to], crc
            at = to


def read_shards(manifest: DataFrame, folder: str, vocabulary: int) -> DataFrame:
    """READ for every document in the files that the manifest names."""
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def read(batches):
        fs, root = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                for ids, start, n, crc in _documents(fs, root, row["shard"], row["base"], row["n_docs"], row["n_tokens"], kind):
                    doc = pa.array(ids, pa.int64(), mask=ids == NULL_ID)
                    yield pa.RecordBatch.from_arrays([doc, pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.mapInArrow(read, READ)


def token_files(docs: DataFrame, tokenizer_file: str, end_id: int, vocabulary: int, folder: str | None = None, word_parts: bool | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Write the data set of `docs`; its manifest (with `base`), and READ, from the files.

    `tokenizer_file` is the path of a tokenizer's JSON file on every machine.
    """
    spark: SparkSession = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    folder = on_default_file_system(spark, folder)
    shards = partitions(spark)
    word_parts = drops_space(tokenizer_file) if word_parts is None else word_parts
    written = write_shards(texts(docs, id_col, text_col), folder, tokenizer_file, end_id, vocabulary, shards, word_parts)
    path = f"{folder}/shards.parquet"
    written.write.parquet(path)
    found = spark.read.parquet(path)
    # One row for each shard: as many as partitions, however many documents.
    before = W.orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    manifest = found.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))
    return manifest, read_shards(manifest.repartitionByRange(shards, "place"), folder, vocabulary)
