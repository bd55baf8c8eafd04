"""Dataset partitioning by identity tag and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biasframe.functions.labels import equals_one
from biasframe.schema import IDENTITY_COLUMNS, TOXICITY_PROJECTION


def tagged_rows(df: DataFrame, tags: Sequence[str] = IDENTITY_COLUMNS,
                projection: Sequence[str] = TOXICITY_PROJECTION) -> DataFrame:
    """One row per (row, tag) with the tag exactly 1; a row appears
    under every tag it carries. Write with ``partitionBy('tag')`` for the
    per-tag datasets (A5)."""
    hits = F.array(*[F.when(equals_one(t), F.lit(t)) for t in tags])
    return (df.select(*projection, F.explode(F.array_compact(hits)).alias("tag")))


def untagged_rows(df: DataFrame, id_col: str = "id", tags: Sequence[str] = IDENTITY_COLUMNS,
                  projection: Sequence[str] = TOXICITY_PROJECTION) -> DataFrame:
    """Rows that carry no tag, by an anti join on the id."""
    tagged_ids = tagged_rows(df, tags, [id_col]).select(id_col)
    return df.join(tagged_ids, id_col, "left_anti").select(*projection)


def toxicity_projection(df: DataFrame) -> DataFrame:
    """J7."""
    return df.select(*TOXICITY_PROJECTION)


def union_filters(df: DataFrame, first: Column, second: Column) -> DataFrame:
    """Append two disjoint filtered subsets - one filter, no union."""
    return df.where(first | second)


def attach_predictions(labels: DataFrame, predictions: DataFrame, id_col: str = "id",
                       how: str = "inner") -> DataFrame:
    """Predictions meet labels by key, not by position."""
    return labels.join(predictions, id_col, how)


def word_set_difference(a: DataFrame, b: DataFrame, col: str = "word") -> DataFrame:
    """Distinct words of ``a`` not in ``b`` (EXCEPT DISTINCT)."""
    return a.select(col).subtract(b.select(col))
