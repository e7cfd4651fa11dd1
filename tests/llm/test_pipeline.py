"""The pipeline's stages on a small corpus: what stays, what changes, and which columns."""

import os
import random

import public_tokenizers
import pytest
from texts import edited

import corpus_pipeline as C
from logloom.llm import sp_viterbi

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentences(rnd, n):
    return " ".join(f"{' '.join(f'w{rnd.randrange(3000)}' for _ in range(9))}." for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd, rows = random.Random(9), []
    for d in range(60):
        rows.append((d, sentences(rnd, 6)))
    rows += [(100, rows[0][1]), (101, edited(rnd, rows[1][1], 0.005)), (102, f"{sentences(rnd, 5)} mail x@y.org now."), (103, "a | b | c | d"), (104, None), (105, "")]
    path = str(tmp_path_factory.mktemp("tables"))
    full = [(d, t, "en", "s", len(t) if t is not None else None) for d, t in rows]
    spark.createDataFrame(full, SCHEMA).write.parquet(os.path.join(path, "documents.parquet"))
    spark.createDataFrame([(d, 1, int(d % 20 == 7)) for d in range(60)], "doc_id long, quality int, toxic int").write.parquet(os.path.join(path, "labels.parquet"))
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(os.path.join(folder, "documents.parquet"))
    first = C.clean(spark, docs, folder).cache()
    assert first.dtypes == docs.dtypes and {r.doc_id for r in first.collect()} == {*range(60), 100, 101, 102}
    second = C.deduplicate(spark, first, folder).cache()
    assert second.dtypes == docs.dtypes and {r.doc_id for r in second.collect()} == {*range(60), 102}
    third = C.redact(spark, second, folder).cache()
    assert third.dtypes == docs.dtypes
    text = {r.doc_id: (r.text, r.n_chars) for r in third.collect()}
    assert "[EMAIL]" in text[102][0] and "x@y.org" not in text[102][0] and all(len(t) == n for t, n in text.values())
    fourth = C.mix(spark, third, folder)
    assert fourth.dtypes == docs.dtypes and {r.doc_id for r in fourth.collect()} <= set(text)


def test_run(spark, folder):
    assert [n for n, _ in C.STAGES] == ["quality_rules", "near_duplicates", "pii", "mixing", "sentencepiece"]
    rows = C.run(spark, folder).collect()
    p = sp_viterbi.pieces(public_tokenizers.path(C.PIECE_MODEL))
    assert rows and all(len(r.ids) == r.n_tokens and p.decode(r.ids).decode().startswith("w") for r in rows)


def test_empty_documents(spark, folder, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(os.path.join(folder, "labels.parquet")).write.parquet(str(tmp_path / "labels.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0
