"""Order-dependent building blocks that stay distributed.

A window without ``PARTITION BY`` (or partitioned by a few hot keys) runs in
one task. Two helpers replace it everywhere in the package:

* ``running_sums_below`` - exclusive running sums of value columns within
  groups, in the order of one column. Rows are range-partitioned on (group,
  order), so every task holds one contiguous slice; per-slice running sums are
  computed locally, and the one group that enters a slice from the one before it
  (at most one a slice) gets a carry-in.
* ``dense_index`` - consecutive 0-based positions in a total order (the
  DataFrame form of ``zipWithIndex``): global sort, per-partition counts, and an
  offset per partition.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from biasframe.session import checkpoint_dir


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Used where one intermediate feeds several branches of a plan: without it
    each branch would recompute the whole upstream plan (Catalyst prunes the
    branches differently, so their exchanges are not reused). It also freezes
    values computed from partition ids, so a retried task sees the same ones."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder and read back:
    for narrow columns that are scanned several times. Unlike a checkpoint it
    prunes columns, and the planner knows its size."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _by_range(df: DataFrame, parts: int | None, *keys: Column) -> DataFrame:
    """Range-partition on ``keys``. Without an explicit count the shuffle uses
    ``spark.sql.shuffle.partitions`` (sized for the cluster) and AQE may merge
    adjacent small slices; merged slices stay contiguous, so partition ids
    remain ordered."""
    return df.repartitionByRange(int(parts), *keys) if parts else df.repartitionByRange(*keys)


def running_sums_below(df: DataFrame, group_cols: Sequence[str], order_col: str,
                       value_cols: Sequence[str], parts: int | None = None,
                       suffix: str = "_below") -> DataFrame:
    """Add ``<v><suffix>`` = sum of ``v`` over the rows of the same group whose
    ``order_col`` is strictly smaller. Input rows must be distinct on
    ``group_cols + [order_col]`` (e.g. the output of a ``groupBy``).

    Rows are ranged on (group, order), so a group's rows are neighbours: most
    groups lie in one slice and need no carry. Only a group that goes on over the
    edge of a slice has one, so the carry table has fewer rows than there are
    slices, however many groups there are. No task holds more than one slice."""
    g = list(group_cols)
    ranged = materialize(_by_range(df, parts, *[F.col(c) for c in g], F.col(order_col))
                         .withColumn("_slice", F.spark_partition_id()))
    inner = Window.partitionBy(*g, "_slice").orderBy(order_col).rowsBetween(
        Window.unboundedPreceding, -1)
    local = ranged.select("*", *[F.coalesce(F.sum(v).over(inner), F.lit(0)).alias(f"_in_{v}")
                                 for v in value_cols])
    totals = ranged.groupBy(*g, "_slice").agg(*[F.sum(v).alias(f"_tot_{v}") for v in value_cols])
    before = Window.partitionBy(*g).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    later = totals.select(*[F.col(c).alias(f"_g_{c}") for c in g], F.col("_slice").alias("_at"), F.lag("_slice").over(Window.partitionBy(*g).orderBy("_slice")).alias("_last"),
                          *[F.sum(f"_tot_{v}").over(before).alias(f"_carry_{v}") for v in value_cols])
    carry = later.where(F.col("_last").isNotNull()).drop("_last")  # slices that a group enters from the one before
    same = F.col("_slice") == F.col("_at")
    for c in g:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    out = local.join(F.broadcast(carry), same, "left")  # at most one row a slice
    return out.select(*df.columns, *[(F.col(f"_in_{v}") + F.coalesce(F.col(f"_carry_{v}"), F.lit(0))).alias(f"{v}{suffix}")
                                     for v in value_cols])


def dense_index(df: DataFrame, order: Sequence[Column | str], name: str = "row_index",
                parts: int | None = None, total_name: str | None = None) -> DataFrame:
    """Add ``name`` = 0-based position of each row in ``order``.

    ``order`` must be a total order (end it with a unique key). Optionally add
    ``total_name`` = number of rows. Work per task is rows / parts."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = materialize(_by_range(df, parts, *keys).sortWithinPartitions(*keys)
                           .withColumn("_slice", F.spark_partition_id())
                           .withColumn("_mono", F.monotonically_increasing_id()))
    counts = ranged.groupBy("_slice").agg(F.count(F.lit(1)).alias("_cnt"))
    # one row per range slice (bounded by ``parts``)
    w = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_slice", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"),
                            F.sum("_cnt").over(Window.partitionBy()).alias("_total"))
    out = ranged.join(F.broadcast(offsets), "_slice")
    pos = F.col("_off") + F.col("_mono") - F.shiftleft(F.col("_slice").cast("long"), 33)
    cols = [*[F.col(c) for c in df.columns], pos.alias(name)]
    if total_name:
        cols.append(F.col("_total").alias(total_name))
    return out.select(*cols)


def ranked(df: DataFrame, order: Sequence[Column | str], name: str = "position") -> DataFrame:
    """Rows in ``order`` (a total order) with their 1-based position as a
    column, so the order survives being written or joined."""
    return dense_index(df, order, name=name).withColumn(name, F.col(name) + 1).orderBy(name)


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row DataFrame (a global aggregate) to
    every row as a scalar subquery: computed once, inlined as a value."""
    cols = one_row.columns
    packed = one_row.select(F.struct(*cols).alias("_t")).scalar()
    return df.withColumn("_t", packed).select(*df.columns, *[F.col("_t")[c].alias(c) for c in cols])


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition by ``key`` only when the scan yields fewer partitions
    than the cluster has cores (e.g. a file with a single row group); large
    inputs already come in many splits and are left alone."""
    sc = df.sparkSession.sparkContext
    n = sc.defaultParallelism
    if df.rdd.getNumPartitions() < n:
        return df.repartition(n, F.col(key))
    return df
