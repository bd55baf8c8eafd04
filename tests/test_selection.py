"""Order statistics by counts and segmented running sums, against plain Python."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from biasframe.operators import ordering, sample, selection

rnd = np.random.RandomState(3)
CASES = {
    "normal": rnd.randn(3000),
    "hot": np.r_[np.zeros(2000), rnd.randn(500), np.full(1500, 7.25)],
    "magnitudes": np.r_[10.0 ** rnd.uniform(-300, 300, 1500), -(10.0 ** rnd.uniform(-300, 300, 1500)), 0.0, -0.0],
    "tiny": rnd.randint(1, 5000, 3000) * 5e-324,
    "ends": np.r_[rnd.randn(50), np.inf, -np.inf, np.full(40, np.inf), 1.7e308, -1.7e308],
    "close": 1.0 + rnd.randint(0, 4000, 3000) * 2.0**-52,
    "one": np.array([4.5]),
    "none": np.array([]),
}


@pytest.mark.parametrize("listed", [0, 100, 4096])
def test_ranks_equal_a_sort(spark, listed, monkeypatch):
    monkeypatch.setattr(selection, "LISTED", listed)
    n = max(map(len, CASES.values()))
    frame = pd.DataFrame({c: np.r_[v, np.full(n - len(v), np.nan)] for c, v in CASES.items()})
    df = spark.createDataFrame(frame.sample(frac=1, random_state=1)).repartition(5)
    df = df.select(*[F.when(~F.isnan(c) | (F.rand(1) < 0.5), F.col(c)).alias(c) for c in CASES])  # NULL and NaN are no values
    counts = {}

    def ranks(found):
        counts.update(found)
        return {c: [0, k // 4, k // 3, k // 2, k - 1, k, -1] for c, k in found.items()}

    got = selection.select_ranks(df, {c: F.col(c) for c in CASES}, ranks)
    for c, v in CASES.items():
        assert counts[c] == len(v)
        want = np.sort(v)
        for r in {0, len(v) // 4, len(v) // 3, len(v) // 2, len(v) - 1} - ({0, -1} if not len(v) else set()):
            f = got[c][r]
            assert f.value == want[r] and f.below == (v < want[r]).sum() and f.equal == (v == want[r]).sum()
        assert set(got[c]) <= set(range(len(v)))


def test_quantiles_equal_pandas(spark):
    frame = pd.DataFrame({"a": rnd.randn(999), "b": rnd.randint(0, 4, 999).astype(float)})
    got = selection.quantiles(spark.createDataFrame(frame), ["a", "b"], [0.0, 0.1, 0.25, 0.5, 0.75, 1.0])
    for c in frame:
        for p, v in got[c].items():
            assert v == pytest.approx(frame[c].quantile(p), rel=1e-12)


@pytest.mark.parametrize("spread", [1, 10, 2**40, 2**62])
def test_whole_numbers(spark, spread):
    r = random.Random(spread)
    v = [r.randrange(-spread, spread) for _ in range(6000)]
    df = spark.createDataFrame([(x,) for x in v], "k long")
    got = selection.select_ranks(df, {"k": F.col("k")}, lambda c: {"k": [0, 17, 2999, 5999]}, whole=True)["k"]
    assert {i: f.value for i, f in got.items()} == {i: sorted(v)[i] for i in (0, 17, 2999, 5999)}


def test_samples_have_their_size_with_ties(spark):
    df = spark.createDataFrame([(i % 40 if i < 4000 else None, i) for i in range(4100)], "id long, v long")  # every id a hundred times
    for n in (0, 1, 99, 100, 101, 2050, 4099, 4100, 9999):
        assert sample.sample_n(df, n).count() == min(n, 4100)
    assert sample.sample_n(df.limit(0), 5).count() == 0
    assert sample.sample_like(df, df.limit(37)).count() == 37


@pytest.mark.parametrize("groups", [1, 3, 5000])
def test_running_sums_of_many_groups(spark, groups):
    r = random.Random(groups)
    rows, seen = [], set()
    for _ in range(8000):
        g = r.randrange(groups) or None if r.random() < 0.6 else 1  # group 1 is hot, one group is NULL
        x = r.randrange(6000) / 4
        if (g, x) not in seen:
            seen.add((g, x))
            rows.append((g, x, r.randrange(5), r.randrange(3)))
    df = spark.createDataFrame(rows, "g long, x double, a long, b long").repartition(4)
    got = {(t.g, t.x): (t.a_below, t.b_below) for t in ordering.running_sums_below(df, ["g"], "x", ["a", "b"], parts=7).collect()}
    want, sums = {}, {}
    for g, x, a, b in sorted(rows, key=lambda t: (t[0] is not None, t[0] or 0, t[1])):
        want[g, x] = sums.get(g, (0, 0))
        sums[g] = (want[g, x][0] + a, want[g, x][1] + b)
    assert got == want


def test_the_carry_has_at_most_a_row_a_slice(spark):
    df = spark.range(20000).select((F.col("id") % 5000).alias("g"), F.col("id").cast("double").alias("x"), F.lit(1).alias("a"))
    plan = ordering.running_sums_below(df, ["g"], "x", ["a"], parts=8)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


