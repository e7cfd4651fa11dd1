"""A corpus from `documents`: quality rules, near-duplicates, personal data, mixing, token ids.

Each stage takes the session, the documents that the stage before left, and the
folder of the tables; its result is written as Parquet and read again for the
next one. All but the last return the columns of `documents`. A stage keeps a
document or leaves it out as its operator decides, and passes on what the
operator made of the text:

* quality rules: rejected documents go, failing lines of others go;
* near-duplicates (five-word shingles, similarity 0.8): one document of each group stays;
* personal data: spans are blanked out;
* mixing: a document comes as often as its rate says, so rows may repeat an id;
* token ids: `doc_id`, the ids of the pieces, and their number.

SQL cannot express the fitted mixture, so there is no ORACLE_SQL; the tests hold
the stages against brute force.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import bottomk_dedup, pii_bootstrap, quality_rules, soft_mixing, sp_viterbi
from logloom.llm.common import shared_dir, table

#: Domains by the label `toxic`, 0 and 1; poor documents have gone in the first stage.
TARGETS = {"civil": 0.98, "toxic": 0.02}
PIECE_MODEL = "piece_bpe_32k.model"


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_clean(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bottomk_dedup.one_of_each(docs, words=5, share=0.8)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii_bootstrap.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return soft_mixing.resampled(docs, table(spark, sf_dir, "labels"), TARGETS, (F.col("toxic") > 0).cast("int"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sp_viterbi.encode(docs, public_tokenizers.path(PIECE_MODEL)).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality_rules", clean), ("near_duplicates", deduplicate), ("pii", redact), ("mixing", mix), ("sentencepiece", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over `documents`."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
