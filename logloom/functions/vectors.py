"""Vector columns: dot/cosine, normalisation, and line encoders.

The default encoder (C3) is signed feature hashing of tokens, written with
Catalyst array functions so it stays in the JVM and a SQL engine can
reproduce it. A real sentence encoder plugs in through `encode_with`, an
iterator pandas UDF that loads the model once per Python worker and encodes
Arrow batches.
"""

from __future__ import annotations

import hashlib
from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from . import text as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    return T.dot(a, b)


def l2norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x))


def normalize(v, eps: float = 0.0) -> Column:
    """v / (||v|| + eps); a zero vector stays zero."""
    n = l2norm(v)
    return F.when(n > 0, F.transform(_c(v), lambda x: (x / (n + F.lit(eps))).cast("float"))) \
        .otherwise(F.transform(_c(v), lambda x: F.lit(0.0).cast("float")))


def token_hash(t: Column) -> Column:
    """32-bit unsigned hash of a token: the first 8 hex digits of its MD5."""
    return F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint")


def hashed_embedding_native(line, dim: int = 64) -> Column:
    """C3 written with Catalyst array functions (O(dim x tokens) per line).

    Same result as `hashed_embedding`; kept for plans that must not start a
    Python worker. Higher-order functions are interpreted, so the Arrow-batched
    version below is the default."""
    hs = F.transform(T.tokens(line), token_hash)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.aggregate(
        hs, F.lit(0.0).cast("double"),
        lambda acc, h: acc + F.when(h % dim == d, F.when(F.floor(h / dim) % 2 == 0, F.lit(1.0))
                                    .otherwise(F.lit(-1.0))).otherwise(F.lit(0.0))))
    return normalize(raw)


_HASH_UDFS: dict = {}


def _hash_vectors(texts, dim: int) -> list:
    cache: dict = {}
    out = []
    for text in texts:
        v = np.zeros(dim)
        for t in (text or "").split():
            h = cache.get(t)
            if h is None:
                h = cache[t] = int(hashlib.md5(t.encode("utf-8")).hexdigest()[:8], 16)
            v[h % dim] += 1.0 if (h // dim) % 2 == 0 else -1.0
        n = np.sqrt((v * v).sum())
        out.append((v / n if n > 0 else v).astype(np.float32))
    return out


def hashed_embedding(line, dim: int = 64) -> Column:
    """Signed feature hashing of tokens into `dim` buckets, L2-normalised.

    Bucket = h mod dim, sign = + when (h div dim) is even, h = first 8 hex
    digits of the token's MD5 — reproducible in SQL. Runs as an Arrow-batched
    scalar pandas UDF (one pass over the tokens). Scores are not comparable
    with a trained sentence encoder's.
    """
    if dim not in _HASH_UDFS:
        @F.pandas_udf(ArrayType(FloatType()))
        def _enc(s: pd.Series) -> pd.Series:
            return pd.Series(_hash_vectors(s.tolist(), dim))
        _HASH_UDFS[dim] = _enc
    return _HASH_UDFS[dim](_c(line))


def encode_with(factory: Callable[[], Callable[[list[str]], np.ndarray]],
                batch_size: int = 64) -> Callable[[Column], Column]:
    """Wrap an encoder factory as an iterator pandas UDF.

    `factory()` runs once per Python worker and returns `encode(list[str]) ->
    (n, dim) float array`; rows are encoded in chunks of `batch_size` and
    L2-normalised, like `normalize_embeddings=True`.
    """
    @F.pandas_udf(ArrayType(FloatType()))
    def _enc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for s in batches:
            texts = s.fillna("").tolist()
            parts = []
            for i in range(0, len(texts), batch_size):
                m = np.asarray(model(texts[i:i + batch_size]), dtype=np.float32)
                nrm = np.linalg.norm(m, axis=1, keepdims=True)
                parts.append(m / np.maximum(nrm, 1e-12))
            out = np.vstack(parts) if parts else np.zeros((0, 1), np.float32)
            yield pd.Series(list(out))
    return lambda c: _enc(_c(c))


def hashing_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """C3 in the shape that `encode_with` takes."""
    return lambda lines: np.array(_hash_vectors(lines, dim), dtype=np.float32).reshape(len(lines), dim)


def encode_lines(df: DataFrame, col: str = "normalised", out: str = "embedding",
                 encoder=None, dim: int = 64) -> DataFrame:
    """Encode a column: native hashed encoder by default, or a pluggable one
    (anything returned by `encode_with`)."""
    enc = encoder(F.col(col)) if encoder is not None else hashed_embedding(F.col(col), dim)
    return df.withColumn(out, enc)


_KEPT = "encoder string, text string, embedding array<float>"


def kept_encode(lines: DataFrame, path: str, name: str, col: str = "normalised", out: str = "embedding",
                encoder=None, dim: int = 64) -> DataFrame:
    """Vectors by content, kept as a Parquet table at `path` (a folder all machines share).

    A row holds an encoder's `name`, a text and its vector; the folder is divided by name,
    so models never mix. Texts of `lines` that the table lacks are encoded once each and
    appended before `lines` is joined to it; a second run encodes nothing. Two runs at once
    may both append a text: one of its rows is taken. A null text counts as an empty one.
    A write that fails appends nothing, so a run can be repeated.
    """
    if not name or out in lines.columns:
        raise ValueError("an encoder needs a name, and `out` a name that the lines do not have")
    spark = lines.sparkSession
    spark.createDataFrame([], _KEPT).write.mode("append").partitionBy("encoder").parquet(path)  # the folder

    def kept():
        table = spark.read.schema(_KEPT).parquet(path).where(F.col("encoder") == name)
        return table.select(F.col("text").alias("_kept_text"), F.col("embedding").alias(out)).dropDuplicates(["_kept_text"])

    text = F.coalesce(F.col(col), F.lit(""))
    new = (lines.select(text.alias("_kept_text")).distinct()
           .join(kept().select("_kept_text"), "_kept_text", "left_anti").withColumnRenamed("_kept_text", "text"))
    rows = encode_lines(new, "text", encoder=encoder, dim=dim).select(F.lit(name).alias("encoder"), "text", "embedding")
    rows.write.mode("append").partitionBy("encoder").parquet(path)
    return lines.join(kept(), text == F.col("_kept_text")).drop("_kept_text")
