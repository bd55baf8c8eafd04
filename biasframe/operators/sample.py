"""Sampling and splits (H1-H8).

Randomness comes from a hash of the row key, so a row's fate does not depend
on partitioning or on task retries (``rand()`` does), and the same split can be
written in SQL. Each operator has its own salt and each seed its own hashes, so
a sample says nothing about a later split of it:

    hash = first 8 hex digits of md5("salt:seed:id")        (in [0, 2^32))

A row without an id hashes as "salt:seed".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biasframe.functions.labels import above, below
from biasframe.operators.ordering import dense_index
from biasframe.operators.selection import smallest

TWO_32 = 4294967296


def row_hash(salt: str, id_col: str = "id", seed: int = 0) -> Column:
    key = F.concat_ws(":", F.lit(salt), F.lit(str(seed)), F.col(id_col).cast("string"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def row_hash_sql(salt: str, id_col: str = "id", seed: int = 0) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', '{salt}', '{seed}', CAST({id_col} AS VARCHAR))), 1, 8) AS BIGINT)"


def shuffle(df: DataFrame, id_col: str = "id", seed: int = 0, position: str | None = None) -> DataFrame:
    """H1: all rows in a seeded pseudo-random order (a distributed sort), with
    their 0-based place in a column ``position`` if named."""
    if position is None:
        return df.orderBy(row_hash("shuffle", id_col, seed), F.col(id_col))
    return dense_index(df, [row_hash("shuffle", id_col, seed), F.col(id_col)], name=position)


def sample_n(df: DataFrame, n: int, id_col: str = "id", seed: int = 0) -> DataFrame:
    """H2: exactly ``min(n, rows)`` rows, those of the smallest hashes. The nth hash
    is found by counts (``selection``), so no task gathers the sample."""
    return smallest(df, row_hash("sample", id_col, seed), n, id_col)


def split_flag(fraction: float, id_col: str = "id", seed: int = 0) -> Column:
    """H3: true for the held-out ``fraction`` of rows."""
    return row_hash("split", id_col, seed) < F.lit(int(fraction * TWO_32))


def train_test_split(df: DataFrame, test_fraction: float, id_col: str = "id",
                     seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """H3: (train, test)."""
    f = split_flag(test_fraction, id_col, seed)
    return df.where(~f), df.where(f)


def balanced_sample(df: DataFrame, n: int, label: str = "target", toxic_share: float = 0.5,
                    id_col: str = "id", seed: int = 0) -> DataFrame:
    """H4: ``n*share`` toxic rows (label > 0.5) and as many non-toxic rows
    (label < 0.5); rows equal to 0.5 are skipped. Each class is cut at its own
    nth hash, found by counts, so no class is gathered into one task."""
    k, key = int(n * toxic_share), row_hash("balanced", id_col, seed)
    return smallest(df.where(above(label, 0.5)), key, k, id_col).unionByName(smallest(df.where(below(label, 0.5)), key, k, id_col))


def holdout_last(df: DataFrame, fraction: float, order: list[str] | None = None) -> DataFrame:
    """H5: ``is_validation`` for the last ``fraction`` of rows in ``order``
    (Keras ``validation_split``: the first ``int(n*(1-f))`` rows train)."""
    order = order or ["id"]
    idx = dense_index(df, order, name="_pos", total_name="_n")
    cut = F.floor(F.col("_n") * F.lit(1.0 - fraction))
    return idx.withColumn("is_validation", F.col("_pos") >= cut).drop("_pos", "_n")


def fold_column(k: int, id_col: str = "id", seed: int = 0) -> Column:
    """H6: fold number 0..k-1 for k-fold cross-validation."""
    return (row_hash("folds", id_col, seed) % k).cast("int")


def sample_like(train: DataFrame, other: DataFrame, id_col: str = "id", seed: int = 0) -> DataFrame:
    """H7: as many rows of ``train`` as ``other`` has, by hash order."""
    return smallest(train, row_hash("like", id_col, seed), other.count(), id_col)
