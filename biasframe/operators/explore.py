"""Exploratory aggregation (I1-I17): profiles, group statistics, histograms,
co-occurrence. Every statistic is one grouped aggregation (partial then final),
never a driver loop over groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biasframe.functions.labels import above, below
from biasframe.operators.ordering import attach_row, stored
from biasframe.operators.selection import quantiles
from biasframe.schema import IDENTITY_COLUMNS


def _long(df: DataFrame, cols: Sequence[str], key: str = "column", val: str = "value",
          ids: Sequence[str] = ()) -> DataFrame:
    """Unpivot ``cols`` to (ids..., key, value) as double."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        list(ids), list(cols), key, val)


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(column, q, value): exact quantiles with linear interpolation (pandas), by
    counts (``selection``): a few scans of the columns, no sort."""
    found = quantiles(stored(df.select(*cols)), cols, probs)
    return df.sparkSession.createDataFrame([(c, float(p), v) for c, own in found.items() for p, v in own.items() if v is not None],
                                           "column string, q double, value double")


def describe(df: DataFrame, cols: Sequence[str], digits: int = 9) -> DataFrame:
    """Count, mean, std (sample), min, 25 %, 50 %, 75 %, max per column,
    one row per column with values. Quartiles are exact (``exact_quantiles``)."""
    narrow = stored(df.select(*cols))
    aggregates = []
    for i, c in enumerate(cols):
        v = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        aggregates += [F.count(v).alias(f"count_{i}"), F.avg(v).alias(f"mean_{i}"), F.stddev_samp(v).alias(f"std_{i}"), F.min(v).alias(f"min_{i}"), F.max(v).alias(f"max_{i}")]
    base = narrow.agg(*aggregates).first()  # one row, five numbers a column
    known = {c: (base[f"count_{i}"], base[f"min_{i}"], base[f"max_{i}"]) for i, c in enumerate(cols)}
    found = quantiles(narrow, cols, [0.25, 0.5, 0.75], known)
    rows = [(c, *[base[f"{n}_{i}"] for n in ("count", "mean", "std", "min", "max")], *found[c].values()) for i, c in enumerate(cols) if base[f"count_{i}"]]
    made = df.sparkSession.createDataFrame(rows, "column string, count long, mean double, std double, min double, max double, q25 double, q50 double, q75 double")
    return made.select("column", "count", F.round("mean", digits).alias("mean"), F.round("std", digits).alias("std"), "min", "max",
                       *[F.round(q, digits).alias(q) for q in ("q25", "q50", "q75")])


def group_means(df: DataFrame, key: str, cols: Sequence[str], digits: int = 9) -> DataFrame:
    """Mean of every numeric column per key."""
    return df.groupBy(key).agg(*[F.round(F.avg(c), digits).alias(c) for c in cols])


def identity_counts(df: DataFrame, cols: Sequence[str] = IDENTITY_COLUMNS) -> DataFrame:
    """Rows mentioning each identity (> 0), one pass, sorted desc."""
    wide = df.agg(*[F.count_if(F.col(c) > 0).alias(c) for c in cols])
    return (wide.unpivot([], list(cols), "identity", "n_comments")
                .orderBy(F.desc("n_comments"), "identity"))


def identity_toxicity(df: DataFrame, label: str = "target", cols: Sequence[str] = IDENTITY_COLUMNS,
                      digits: int = 9) -> DataFrame:
    """I4 (+ B21, C2): per identity, over rows with the identity > 0: mean
    label, toxic (> 0.5) and non-toxic (< 0.5) counts, size. Rows are
    filtered to mentioned identities before the shuffle."""
    long = _long(df, cols, "identity", "v", ids=[label]).where(F.col("v") > 0)
    out = long.groupBy("identity").agg(
        F.avg(label).alias("ratio"), F.count_if(above(label, 0.5)).alias("n_toxic"),
        F.count_if(below(label, 0.5)).alias("n_non_toxic"), F.count(F.lit(1)).alias("size"))
    out = out.select("identity", F.round("ratio", digits).alias("ratio"), "n_toxic", "n_non_toxic", "size",
                     F.round(F.col("ratio") * 100.0, 1).alias("pct_round"),
                     ((F.col("ratio") * 1000.0).cast("long") / F.lit(10.0)).alias("pct_floor"))
    # Largest groups first (one row per identity)
    return out.orderBy(F.desc("size"), "identity")


def histogram(df: DataFrame, value: Column | str, bins: int, by: Sequence[str] = (),
              lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Equal-width histogram (bins half-open, last closed, range = min..max
    per group unless given); empty bins appear with count 0."""
    v = F.col(value) if isinstance(value, str) else value
    vals = df.select(*by, v.cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    rng = vals.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    if lo is not None:
        rng = rng.withColumn("_lo", F.lit(float(lo)))
    if hi is not None:
        rng = rng.withColumn("_hi", F.lit(float(hi)))
    width = F.col("_hi") - F.col("_lo")
    joined = vals.join(rng, list(by)) if by else attach_row(vals, rng)  # broadcast only if the table of groups is small
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("_v") - F.col("_lo")) * bins / width), F.lit(bins - 1))).cast("int")
    counts = (joined.where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
                    .groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("count")))
    grid = rng.select(*by, "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    edge = lambda i: F.col("_lo") + i * (F.col("_hi") - F.col("_lo")) / bins
    return (grid.join(counts, [*by, "bin"], "left")
                .select(*by, "bin", edge(F.col("bin")).alias("bin_lo"), edge(F.col("bin") + 1).alias("bin_hi"),
                        F.coalesce("count", F.lit(0)).alias("count")))


def cooccurrence(df: DataFrame, cols: Sequence[str] = IDENTITY_COLUMNS, digits: int = 9) -> DataFrame:
    """``P(a > 0 | b > 0)`` for every ordered pair a != b of identities.

    No pair rows are emitted: rows are exploded only into the identities they
    mention, and each exploded row carries the 0/1 flags of all identities,
    summed per identity. Result: (#ids x #ids) rows."""
    flags = [(F.col(c) > 0).cast("int").alias(f"_f_{c}") for c in cols]
    mentioned = F.array(*[F.when(F.col(c) > 0, F.lit(c)) for c in cols])
    ex = (df.select(F.explode(F.array_compact(mentioned)).alias("a"), *flags))
    both = ex.groupBy("a").agg(*[F.sum(f"_f_{c}").alias(c) for c in cols])
    counts = both.unpivot(["a"], list(cols), "b", "n_both")
    denom = df.agg(*[F.count_if(F.col(c) > 0).alias(c) for c in cols]).unpivot([], list(cols), "b", "n_b")
    # every ordered pair of the (fixed, small) identity list, unmentioned ones too
    grid = denom.select("b", "n_b", F.explode(F.array(*[F.lit(c) for c in cols])).alias("a"))
    pairs = grid.where(F.col("a") != F.col("b")).join(F.broadcast(counts), ["a", "b"], "left")
    n_both = F.coalesce(F.col("n_both"), F.lit(0))
    return pairs.select(F.col("a").alias("identity"), F.col("b").alias("other"), n_both.alias("n_both"), "n_b",
                        F.round(F.when(F.col("n_b") != 0, n_both / F.col("n_b")), digits).alias("ratio"))


def weighted_average(df: DataFrame, label: str, weight: str, by: Sequence[str] = (),
                     name: str = "weighted_avg") -> DataFrame:
    """``sum(l*w) / sum(w)``; NULL when the weights sum to 0."""
    sw = F.sum(F.col(weight).cast("double"))
    return df.groupBy(*by).agg(F.when(sw != 0, F.sum(F.col(label) * F.col(weight)) / sw).alias(name))
