"""Exact-duplicate handling.

Duplicates are found and collapsed with one grouped aggregation keyed by the
256-bit digest of the text, so no text is shuffled as a key. A text that holds
a third of all rows is still fine: ``count``, ``min`` and the weighted sums are
combined map-side before the shuffle, so each task ships one partial row per text.

NULL texts are duplicates of nothing: J1 never reports them, J2 keeps each such
row with its own label, and J3 counts none of them as removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biasframe.operators.ordering import running_sums_below


def text_key(text: str) -> Column:
    """The digest of a text; NULL for NULL."""
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def row_key(id_col: str, text: str) -> Column:
    """The digest of a text, or the id of a row without one."""
    return F.coalesce(text_key(text), F.concat(F.lit("row "), F.col(id_col).cast("string")).cast("binary"))


def find_duplicates(df: DataFrame, text: str = "comment_text") -> DataFrame:
    """Every row whose text occurs more than once (``keep=False``).

    The duplicated digests meet the rows by an equi-join; AQE splits a hot
    text's partition on the large side (skew join)."""
    keyed = df.withColumn("_key", text_key(text))
    dups = keyed.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return keyed.join(dups.select("_key"), "_key", "left_semi").select(*df.columns)


def collapse_duplicates(df: DataFrame, id_col: str = "id", text: str = "comment_text",
                        label: str = "target", weight: str = "toxicity_annotator_count",
                        digits: int | None = 9) -> DataFrame:
    """Keep the first row (lowest id) of each text; its label becomes the
    weight-averaged label of the copies that have a label (NULL when their
    weights sum to 0). Rows without copies keep their label.

    The per-text aggregate keeps only fixed-width buffers (min id, count,
    sums), so it runs as a hash aggregation combined map-side; the kept rows
    are then fetched by an equi-join on the id. (Carrying the whole first row
    through ``min_by(struct)`` would force a sort-based aggregation on text.)"""
    w = F.when(F.col(label).isNotNull(), F.col(weight).cast("double"))
    sw = F.sum(w)
    g = df.groupBy(row_key(id_col, text).alias("_key")).agg(
        F.min(id_col).alias("_first"),
        F.count(F.lit(1)).alias("_n"),
        F.when(sw != 0, F.sum(F.col(label) * w) / sw).alias("_wavg"))
    firsts = g.select(F.col("_first").alias(id_col), "_n", "_wavg")
    kept = df.join(firsts, id_col)
    new_label = F.when(F.col("_n") > 1, F.col("_wavg")).otherwise(F.col(label))
    if digits is not None:
        new_label = F.round(new_label, digits)
    return kept.select(*[new_label.alias(c) if c == label else F.col(c) for c in df.columns])


def removed_before(df: DataFrame, id_col: str = "id", text: str = "comment_text") -> DataFrame:
    """For each kept row (first of its text), the number of removed rows
    with a smaller id - the position shift the collapse causes. Running counts
    are range-partitioned on the id (``running_sums_below``), never one task."""
    keyed = df.select(id_col, row_key(id_col, text).alias("_key"))
    first = keyed.groupBy("_key").agg(F.min(id_col).alias("_first_id"))
    flagged = (keyed.join(first, "_key")
                 .select(id_col, F.lit(1).alias("_g"),
                         (F.col(id_col) != F.col("_first_id")).cast("long").alias("removed")))
    cum = running_sums_below(flagged, ["_g"], id_col, ["removed"])
    return cum.where(F.col("removed") == 0).select(id_col, F.col("removed_below").alias("n_removed_before"))
