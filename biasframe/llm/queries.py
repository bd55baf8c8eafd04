"""The registered queries of the training-data operators: name -> (builder, SQL or None)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from biasframe.llm import bpe, codes, lexical, mixing, near_dup, ngram_lm, pieces, quality_model, rules, secrets, sharding, topk, warc
from biasframe.llm.common import remainder, written
from biasframe.sources.tables import table

OLD_SHARDS, NEW_SHARDS = 6, 8


def classify_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality_model.train(docs, labels.where(remainder(F.col("doc_id"), 4) != 2))
    scored = quality_model.score(docs, model)
    return scored.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["base"])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def encode_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), digests=True)
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def judge_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))


def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def archive_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def reshard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    laid = sharding.write_layout(docs, OLD_SHARDS, sharding.text_bytes(F.col("text")) + 1)
    total = laid.agg(F.coalesce(F.sum("_rs_size"), F.lit(0))).first()[0]
    shares = [total // NEW_SHARDS + (i < total % NEW_SHARDS) for i in range(NEW_SHARDS)]
    rows = sharding.reshard(laid, shares).select(
        "doc_id", (sharding.text_bytes(F.col("text")) + 1).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "_rs_shard", "_rs_old", "_rs_block", "_rs_key")
    placed = sharding.with_slots(written(rows, "resharded_rows"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("_rs_shard").alias("shard"), "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def search_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(topk.quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")), "quantised")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


def group_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=2, percent=80)


def score_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), remainder(F.col("doc_id"), 7) == 2)


def encode_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), digests=True)
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def rank_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"), 10)


def compress_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.code_table(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


QUERIES = {
    "op1_quality_classifier": (classify_quality, None),
    "op2_quality_rules": (judge_rules, lambda: rules.RULES_SQL),
    "op3_secret_scan": (scan_secrets, None),
    "op4_ngram_lm": (score_texts, None),
    "op5_mixing": (mix_sources, None),
    "op6_bpe": (encode_bpe, None),
    "op7_top_k": (search_vectors, lambda: topk.TOP_K_SQL),
    "op8_near_duplicates": (group_near_duplicates, None),
    "op9_warc": (archive_pages, lambda: warc.WARC_SQL),
    "pipeline": (corpus_pipeline.run, None if corpus_pipeline.ORACLE_SQL is None else lambda: corpus_pipeline.ORACLE_SQL),
    "op10_resharding": (reshard_documents, None),
    "op11_sentencepiece": (encode_pieces, None),
    "op12_lexical_search": (rank_documents, lambda: lexical.SEARCH_SQL),
    "op13_vector_codes": (compress_vectors, lambda: codes.CODES_SQL),
}
