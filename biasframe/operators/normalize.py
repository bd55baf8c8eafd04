"""Projections, casts, fills, label conversion and filters (B, C)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biasframe.functions.labels import at_least, equals_one
from biasframe.functions.text import as_text
from biasframe.operators.ordering import dense_index
from biasframe.operators.selection import select_ranks
from biasframe.schema import (APPROVED_RATING, IDENTITY_ANNOTATOR_THRESHOLD, IDENTITY_COLUMNS,
                              LABEL_THRESHOLD, SCORED_IDENTITIES, SUBTYPE_COLUMNS,
                              TOXICITY_ANNOTATOR_THRESHOLD)

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """B1: rename; names that are absent are ignored (as pandas does)."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def keep_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """B2: keep the listed columns that exist, in the listed order."""
    return df.select(*[c for c in names if c in df.columns])


def text_as_string(df: DataFrame, col: str = "comment_text") -> DataFrame:
    """Text column to string, missing -> empty string."""
    return df.withColumn(col, as_text(col))


def fill_numeric(df: DataFrame, value: float = 0.0, subset: Sequence[str] | None = None) -> DataFrame:
    """Fill missing numeric values (text columns untouched; NaN too)."""
    cols = list(subset) if subset is not None else numeric_columns(df)
    fills = {}
    for f in df.schema.fields:
        if f.name in cols:
            c = F.col(f.name)
            if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
                c = F.nanvl(c, F.lit(None).cast(f.dataType))
            fills[f.name] = F.coalesce(c, F.lit(value).cast(f.dataType))
    return df.withColumns(fills)


def to_bool(df: DataFrame, cols: Sequence[str] = ("target", *SCORED_IDENTITIES),
            threshold: float = LABEL_THRESHOLD) -> DataFrame:
    """``col >= threshold`` with NULL/NaN as false."""
    return df.withColumns({c: at_least(c, threshold) for c in cols})


def rule_table_columns(article_col: str = "article_id") -> dict[str, Column]:
    """The per-column boolean rules of the 19-label conversion."""
    rules: dict[str, Column] = {c: at_least(c, LABEL_THRESHOLD)
                                for c in ["target", *SCORED_IDENTITIES, *SUBTYPE_COLUMNS]}
    rules["rating"] = F.coalesce(F.col("rating") == F.lit(APPROVED_RATING), F.lit(False))
    rules["toxicity_annotator_count"] = at_least("toxicity_annotator_count", TOXICITY_ANNOTATOR_THRESHOLD)
    rules["identity_annotator_count"] = at_least("identity_annotator_count", IDENTITY_ANNOTATOR_THRESHOLD)
    rules[article_col] = F.col(article_col)
    return rules


def apply_rule_table(df: DataFrame) -> DataFrame:
    """B6 as one projection."""
    return df.withColumns(rule_table_columns())


def identities_equal_one(df: DataFrame, cols: Sequence[str] = IDENTITY_COLUMNS) -> DataFrame:
    """Identity tags by exact equality with 1."""
    return df.withColumns({c: equals_one(c) for c in cols})


def label_matrix(cols: Sequence[str]) -> Column:
    """One array column from boolean label columns."""
    return F.array(*[F.col(c) for c in cols])


def label_index(df: DataFrame, col: str, out: str) -> DataFrame:
    """Index categories in sorted order (0-based), as ``LabelEncoder``.
    Only the distinct categories are sorted (distributed), and joined back."""
    cats = df.select(F.col(col).alias("_cat")).where(F.col("_cat").isNotNull()).distinct()
    ranked = dense_index(cats, ["_cat"], name=out)
    return df.join(ranked.withColumnRenamed("_cat", col), col, "left")


def head(df: DataFrame, n: int, order: Sequence[str] = ("id",)) -> DataFrame:
    """First n rows in an explicit order (a top-k, not a full sort)."""
    return df.orderBy(*order).limit(n)


def row_at(df: DataFrame, position: int, order: Sequence[str] = ("id",)) -> DataFrame:
    """The row at a 0-based position of an explicit order (NULLs first). With a
    column of whole numbers its value is found by counts, and only rows that
    share it are ordered; other orders are sorted, distributed."""
    c = order[0]
    if len(order) == 1 and isinstance(df.schema[c].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        missing = df.where(F.col(c).isNull()).count()
        if position >= missing:
            at = select_ranks(df, {c: F.col(c)}, lambda n: {c: [position - missing]}, whole=True)[c].get(position - missing)
            if at is None:
                return df.limit(0)
            rows, position = df.where(F.col(c) == at.value), position - missing - at.below
            if at.equal == 1:
                return rows
            return dense_index(rows, [c], name="_pos").where(F.col("_pos") == position).drop("_pos")
    return (dense_index(df, list(order), name="_pos")
            .where(F.col("_pos") == position).drop("_pos"))


def drop_missing_text(df: DataFrame, col: str = "comment_text") -> DataFrame:
    """C8."""
    return df.where(F.col(col).isNotNull())
