"""Scalar label and score functions (B5-B21). All are native Column
expressions, so they compile into whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def no_nan(c: Column | str) -> Column:
    """NaN -> NULL. Spark orders NaN above every number, so ``NaN >= 0.5`` is
    true; pandas says false. Thresholds go through this first."""
    d = _c(c).cast("double")
    return F.nanvl(d, F.lit(None).cast("double"))


def at_least(c: Column | str, threshold: float) -> Column:
    """``value >= threshold`` with NULL and NaN as false."""
    return F.coalesce(no_nan(c) >= F.lit(float(threshold)), F.lit(False))


def above(c: Column | str, threshold: float) -> Column:
    """Strict ``value > threshold`` (C2), NULL and NaN false."""
    return F.coalesce(no_nan(c) > F.lit(float(threshold)), F.lit(False))


def below(c: Column | str, threshold: float) -> Column:
    """Strict ``value < threshold`` (C2), NULL and NaN false."""
    return F.coalesce(no_nan(c) < F.lit(float(threshold)), F.lit(False))


def equals_one(c: Column | str) -> Column:
    """Identity tag by exact equality with 1."""
    return F.coalesce(no_nan(c) == F.lit(1.0), F.lit(False))


def as_class(c: Column | str, threshold: float = 0.5) -> Column:
    """0/1 integer class."""
    return at_least(c, threshold).cast("int")


def nonzero(c: Column | str) -> Column:
    """Any non-zero score is true (the reference's ``astype(bool)``;
    NaN is non-zero there, NULL is false)."""
    d = _c(c).cast("double")
    return F.coalesce(F.isnan(d) | (d != F.lit(0.0)), F.lit(False))


def softmax_positive(logit0: Column | str, logit1: Column | str) -> Column:
    """Probability of class 1 from two logits / log-probabilities,
    in the overflow-safe form ``1 / (1 + exp(a0 - a1))``."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(_c(logit0) - _c(logit1)))


def hour_decimal(ts: Column | str) -> Column:
    """Hour of day as ``h + m/60`` (seconds ignored, as the reference)."""
    t = _c(ts)
    return F.hour(t) + F.minute(t) / F.lit(60.0)


def one_hot(c: Column | str, classes: int = 2) -> Column:
    """One-hot array of a 0..k-1 integer label."""
    v = _c(c).cast("int")
    return F.array(*[(v == F.lit(i)).cast("double") for i in range(classes)])


def percent_round(c: Column | str) -> Column:
    """``round(r*100, 1)``."""
    return F.round(_c(c) * 100.0, 1)


def percent_floor(c: Column | str) -> Column:
    """``int(r*1000)/10`` (truncation toward zero)."""
    return (_c(c) * 1000.0).cast("long") / F.lit(10.0)
