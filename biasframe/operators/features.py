"""Row-level feature assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biasframe.functions import text as X
from biasframe.schema import IDENTITY_COLUMNS


def feature_columns(text: Column | str, profanity_words: Sequence[str] = ()) -> list[Column]:
    """The 30 features in the reference's order: punctuation count, longest
    runs of ``!``, ``*``, ``.``, 24 identity-name counts, profanity flag,
    word count."""
    t = X.as_text(text)
    feats = [X.punctuation_count(t)]
    feats += [X.longest_run(t, ch) for ch in X.AGGRESSIVE_PUNCTUATION]
    feats += [X.substring_count(t, name) for name in IDENTITY_COLUMNS]
    prof = X.contains_any_word(t, list(profanity_words)) if profanity_words else F.lit(False)
    feats += [prof.cast("int"), X.word_count(t)]
    return feats


FEATURE_NAMES = (["n_punct", "run_excl", "run_star", "run_dot"]
                 + [f"n_{c}" for c in IDENTITY_COLUMNS] + ["has_profanity", "n_words"])


def add_features(df: DataFrame, text: str, profanity_words: Sequence[str] = (),
                 as_array: str | None = None) -> DataFrame:
    """One column per feature, or one ``array<double>``."""
    feats = feature_columns(text, profanity_words)
    if as_array:
        return df.withColumn(as_array, F.array(*[f.cast("double") for f in feats]))
    return df.withColumns(dict(zip(FEATURE_NAMES, feats)))


def append_features(vec: Column | str, feats: Column | str) -> Column:
    """Embedding vector followed by the feature values."""
    v = F.col(vec) if isinstance(vec, str) else vec
    f = F.col(feats) if isinstance(feats, str) else feats
    return F.concat(v.cast("array<double>"), f.cast("array<double>"))


def identity_tag_count(columns: Sequence[str] = IDENTITY_COLUMNS) -> Column:
    """Number of identity columns set (non-zero, NULL as 0) on the row."""
    return sum((F.coalesce(F.col(c), F.lit(0.0)) != 0).cast("int") for c in columns)


def flag_words(df: DataFrame, id_col: str, text: str, words: DataFrame, out: str = "has_word",
               word_col: str = "word") -> DataFrame:
    """E4 for a word list of any size: whitespace tokens (lower case) are
    semi-joined with the list and the flag joined back on ``id_col``.
    The list is not broadcast blindly; AQE broadcasts it when it is small."""
    toks = (df.select(id_col, F.explode(X.whitespace_tokens(F.lower(X.as_text(text)))).alias("_tok"))
              .join(words.select(F.col(word_col).alias("_tok")).distinct(), "_tok", "left_semi")
              .select(id_col).distinct().withColumn(out, F.lit(True)))
    return (df.join(toks, id_col, "left")
              .withColumn(out, F.coalesce(F.col(out), F.lit(False))))
