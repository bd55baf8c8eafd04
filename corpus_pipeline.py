"""A corpus pipeline of five stages, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet to the shared folder and read again as the next stage's documents.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from biasframe.llm import bpe, mixing, near_dup, quality_model, secrets
from biasframe.llm.common import written
from biasframe.sources.tables import table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: texts it scores below 0.7 go."""
    model = quality_model.train(docs, table(spark, sf_dir, "labels"))
    names = ("_quality_score", "_quality_keeps")  # columns of the documents keep their names and values
    return quality_model.score(docs, model, 0.7, outputs=names).where("_quality_keeps = 1").select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-duplicates (five words, similarity 0.8): one of each group stays."""
    return near_dup.keep_one(docs, width=5, percent=80)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: every found span is replaced by a mask, the text stays."""
    return secrets.redact(docs, count_col="n_chars" if "n_chars" in docs.columns else None)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: every text as often as the mix takes it."""
    return mixing.repeat_rows(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE ids, and the digest of their decoding."""
    done = bpe.encode_decode(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.json"), digests=True)
    return done.select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("quality_classifier", classify), ("near_duplicates", deduplicate), ("secret_scan", remove_secrets),
          ("source_mixing", mix), ("bpe", tokenize)]

#: Trained scores, hash sketches and random rounding have no SQL form; a test compares each stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
