"""Queries for text cleaning (D) and text features (E)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biasframe.functions import sqltext as S
from biasframe.functions import text as X
from biasframe.operators.features import FEATURE_NAMES, feature_columns, identity_tag_count
from biasframe.schema import IDENTITY_COLUMNS
from biasframe.sources.comments import comments, with_comments
from biasframe.sources.tables import table

# A small flag-word list for feature 28 (the reference takes its list from a
# library that is not part of it; here it is a parameter).
FLAG_WORDS = ["sad", "stop"]

_STEPS = {
    "d1_emoticons": (X.clean_emoticons, S.emoticons),
    "d2_urls": (X.clean_urls, S.urls),
    "d3_whitespace": (X.collapse_whitespace, S.whitespace),
    "d4_negation": (X.clean_negation, S.negation),
    "d5_special_chars": (X.clean_special_chars, S.special_chars),
    "d6_numbers": (X.clean_numbers, S.numbers),
    "d7_clean": (X.clean, S.clean),
    "d8_lower": (X.lower, lambda t: f"lower({t})"),
}


def _step_query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return comments(spark, sf_dir).select("id", fn(F.col("noisy_text")).alias("text_out"))
    return run


def _step_sql(fn):
    return lambda: with_comments(f"SELECT id, {fn('noisy_text')} AS text_out FROM comments")


def urls_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.clean_urls("url").alias("url_out"))


def urls_pages_sql() -> str:
    return f"SELECT page_id, {S.urls('url')} AS url_out FROM pages"


def clean_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", X.lower(X.clean(X.as_text("text"))).alias("text_out"))


def clean_conversations_sql() -> str:
    cleaned = S.clean("coalesce(text, '')")
    return f"SELECT conv_id, turn, lower({cleaned}) AS text_out FROM conversations"


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = feature_columns(F.col("noisy_text"), FLAG_WORDS)
    return comments(spark, sf_dir).select(
        "id", *[c.cast("long").alias(n) for c, n in zip(cols, FEATURE_NAMES)])


def features_sql() -> str:
    t = "noisy_text"
    cols = [S.punctuation_count(t)] + [S.longest_run(t, ch) for ch in X.AGGRESSIVE_PUNCTUATION]
    cols += [S.substring_count(t, name) for name in IDENTITY_COLUMNS]
    words = "[" + ", ".join(S.q(w) for w in FLAG_WORDS) + "]"
    cols += [f"CAST(len(list_intersect({S.tokens(f'lower({t})')}, {words})) > 0 AS INTEGER)", S.word_count(t)]
    sel = ", ".join(f"CAST({c} AS BIGINT) AS {n}" for c, n in zip(cols, FEATURE_NAMES))
    return with_comments(f"SELECT id, {sel} FROM comments")


def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 features as one array<double>."""
    cols = feature_columns(F.col("noisy_text"), FLAG_WORDS)
    return comments(spark, sf_dir).select("id", F.array(*[c.cast("double") for c in cols]).alias("features"))


def feature_vector_sql() -> str:
    t = "noisy_text"
    cols = [S.punctuation_count(t)] + [S.longest_run(t, ch) for ch in X.AGGRESSIVE_PUNCTUATION]
    cols += [S.substring_count(t, name) for name in IDENTITY_COLUMNS]
    words = "[" + ", ".join(S.q(w) for w in FLAG_WORDS) + "]"
    cols += [f"CAST(len(list_intersect({S.tokens(f'lower({t})')}, {words})) > 0 AS INTEGER)", S.word_count(t)]
    return with_comments("SELECT id, [" + ", ".join(f"CAST({c} AS DOUBLE)" for c in cols) + "] AS features FROM comments")


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = comments(spark, sf_dir)
    return c.select("id", X.word_count("comment_text").cast("long").alias("n_words"),
                    X.space_split_count("comment_text").cast("long").alias("n_pieces"))


def word_counts_sql() -> str:
    return with_comments(f"SELECT id, CAST({S.word_count('comment_text')} AS BIGINT) AS n_words, "
                         f"CAST({S.space_split_count('comment_text')} AS BIGINT) AS n_pieces FROM comments")


def tag_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comments(spark, sf_dir).select("id", identity_tag_count().cast("long").alias("n_tags"))


def tag_count_sql() -> str:
    s = " + ".join(f"CASE WHEN coalesce({c}, 0) <> 0 THEN 1 ELSE 0 END" for c in IDENTITY_COLUMNS)
    return with_comments(f"SELECT id, CAST({s} AS BIGINT) AS n_tags FROM comments")


QUERIES = {name: (_step_query(fn), _step_sql(sql)) for name, (fn, sql) in _STEPS.items()}
QUERIES.update({
    "d2_urls_pages": (urls_pages, urls_pages_sql),
    "d7_clean_conversations": (clean_conversations, clean_conversations_sql),
    "e1_e5_features": (features, features_sql),
    "e7_feature_vector": (feature_vector, feature_vector_sql),
    "e5_e6_word_counts": (word_counts, word_counts_sql),
    "e9_identity_tag_count": (tag_count, tag_count_sql),
})
