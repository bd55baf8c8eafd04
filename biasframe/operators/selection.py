"""Exact order statistics from counts, without a sort.

The kth smallest value of a column is found by histograms: the interval that must
hold it is cut into ``BUCKETS`` buckets by an expression that never decreases with
the value, rows are counted by bucket (combined map-side, so a value that a third
of the rows share is one count), and the bucket of the wanted rank, narrowed to
its least and greatest value, is the next interval. It ends where these two are
equal, or the few values left are listed. All ranks of all columns are narrowed
together, one scan a round. A round divides the range of the values, or of their
logarithms where it spans magnitudes, by ``BUCKETS``; the driver gets at most
that many counts for each interval.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024
#: Rows of an interval whose values are listed with their counts.
LISTED = 4096


@dataclass
class Found:
    """A value of a wanted rank, and the numbers of values below and equal to it."""

    value: float
    below: int
    equal: int


@dataclass
class _Interval:
    column: str
    lo: float
    hi: float
    below: int  # values of the column under lo
    count: int
    ranks: list[int] = field(default_factory=list)


def _bucket(v: Column, lo: float, hi: float) -> Column:
    """A bucket number that never decreases with ``v`` in [lo, hi], different for
    the two ends."""
    if isinstance(lo, int):
        wide = "decimal(20,0)" if hi - lo >= 1 << 52 else "long"  # the quotients of longs are doubles
        return F.floor((v.cast(wide) - F.lit(lo).cast(wide)) / F.lit((hi - lo) // BUCKETS + 1).cast(wide)).cast("int")
    if lo <= 0 <= hi or math.isinf(lo) or math.isinf(hi):
        return F.when(v == float("-inf"), 0).when(v < 0, 1).when(v == 0, 2).when(v < float("inf"), 3).otherwise(4)
    small, large = min(abs(lo), abs(hi)), max(abs(lo), abs(hi))
    if large > 4.0 * BUCKETS * small:
        share = (F.log(F.abs(v)) - F.log(F.lit(small))) / (F.log(F.lit(large)) - F.log(F.lit(small)))
        share = share if lo > 0 else 1 - share
    else:
        share = (v - F.lit(lo)) / F.lit(hi - lo)
    return F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def _scan(df: DataFrame, values: Mapping[str, Column], intervals: Sequence[_Interval], key: Callable[[Column, _Interval], Column]) -> dict:
    """Per interval (key, count, least, greatest) of the values in it, by key."""
    kind = "long" if isinstance(intervals[0].lo, int) else "double"
    hits = []
    for i, n in enumerate(intervals):
        v = values[n.column].cast(kind)
        hits.append(F.when((v >= F.lit(n.lo)) & (v <= F.lit(n.hi)), F.struct(F.lit(i).alias("i"), key(v, n).alias("k"), v.alias("v"))))
    rows = df.select(F.explode(F.array(*hits)).alias("h")).where(F.col("h").isNotNull()).select("h.*")
    out: dict = {i: [] for i in range(len(intervals))}
    for r in rows.groupBy("i", "k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
        out[r.i].append((r.lo, r.hi, r.n))
    return {i: sorted(parts) for i, parts in out.items()}


def _narrowed(n: _Interval, parts: list[tuple]) -> list[_Interval]:
    """The parts of an interval that hold its ranks."""
    out, below, ranks = [], n.below, sorted(n.ranks)
    for lo, hi, count in parts:
        own = [r for r in ranks if below <= r < below + count]
        if own:
            out.append(_Interval(n.column, lo, hi, below, count, own))
        below += count
    return out


def select_ranks(df: DataFrame, values: Mapping[str, Column], ranks: Callable[[dict[str, int]], Mapping[str, Sequence[int]]],
                 whole: bool = False, known: Mapping[str, tuple] | None = None) -> dict[str, dict[int, Found]]:
    """For each column the values at some 0-based ranks among its values that are
    neither NULL nor NaN. ``ranks`` maps the columns' numbers of such values to
    the ranks; those out of range are left out. ``whole``: the columns hold longs.
    ``known``: (number of values or None, least, greatest) of each column, if they are known
    or bounded, which saves a scan."""
    kind = "long" if whole else "double"

    def clean(v: Column) -> Column:
        return v.cast(kind) if whole else F.nanvl(v.cast(kind), F.lit(None).cast(kind))

    if known is None:
        first = df.agg(*[f(clean(v)).alias(f"{i}_{name}") for i, v in enumerate(values.values()) for name, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
        known = {c: (first[f"{i}_n"], first[f"{i}_lo"], first[f"{i}_hi"]) for i, c in enumerate(values)}
    names = list(values)
    wanted = ranks({c: n for c, (n, _, _) in known.items()})
    open_ = [_Interval(c, lo, hi, 0, LISTED + 1 if n is None else n, own) for c, (n, lo, hi) in known.items()
             if (own := sorted({r for r in wanted.get(c, ()) if r >= 0 and (n is None or r < n)}))]
    done: list[_Interval] = []
    cleaned = {c: clean(v) for c, v in values.items()}
    while True:
        done += [n for n in open_ if n.lo == n.hi]
        open_ = [n for n in open_ if n.lo != n.hi]
        if not open_:
            break
        if all(n.count <= LISTED for n in open_):
            found = _scan(df, cleaned, open_, lambda v, n: v)
        else:
            found = _scan(df, cleaned, open_, lambda v, n: _bucket(v, n.lo, n.hi).cast(kind))
        open_ = [p for i, n in enumerate(open_) for p in _narrowed(n, found[i])]
    out: dict[str, dict[int, Found]] = {c: {} for c in names}
    for n in done:
        out[n.column].update({r: Found(n.lo, n.below, n.count) for r in n.ranks})
    return out


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], known: Mapping[str, tuple] | None = None) -> dict[str, dict[float, float | None]]:
    """Exact quantiles with linear interpolation (as in pandas), None for columns
    without values. ``known`` as in ``select_ranks``, with the numbers of values."""
    seen: dict[str, int] = {}

    def ranks(counts: dict[str, int]) -> dict[str, list[int]]:
        seen.update(counts)
        return {c: [r for p in probs for r in (math.floor((n - 1) * p), math.ceil((n - 1) * p))] for c, n in counts.items() if n}

    found = select_ranks(df, {c: F.col(c) for c in cols}, ranks, known=known)
    out: dict[str, dict[float, float | None]] = {}
    for c in cols:
        out[c] = {}
        for p in probs:
            if not seen[c]:
                out[c][p] = None
                continue
            h = (seen[c] - 1) * p
            lo, hi = found[c][math.floor(h)].value, found[c][math.ceil(h)].value
            out[c][p] = lo if lo == hi else lo + (h - math.floor(h)) * (hi - lo)
    return out


def smallest(df: DataFrame, key: Column, n: int, tie: str, greatest: int = 2**32 - 1) -> DataFrame:
    """The ``n`` rows with the smallest ``key`` (from 0 to ``greatest``, never NULL), ties by the
    column ``tie`` and then arbitrary: exactly ``n`` rows, or all if fewer. Only
    rows whose key equals the nth are ordered (with a hash of 32 bits as key, about
    one in four billion)."""
    if n <= 0:
        return df.limit(0)
    at = select_ranks(df, {"key": key}, lambda counts: {"key": [n - 1]}, True, {"key": (None, 0, greatest)})["key"].get(n - 1)
    if at is None:
        return df
    if at.below + at.equal == n:
        return df.where(key <= F.lit(at.value))
    ties = df.where(key == F.lit(at.value)).orderBy(tie).limit(n - at.below)
    return df.where(key < F.lit(at.value)).unionByName(ties)
