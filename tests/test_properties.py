"""Property and brute-force checks of the distributed building blocks."""

import random

import pytest
from pyspark.sql import functions as F

from biasframe.operators import metrics, ordering, sample


def brute_auc(pairs):
    pos = [s for s, y in pairs if y]
    neg = [s for s, y in pairs if not y]
    if not pos or not neg:
        return None
    hits = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return hits / (len(pos) * len(neg))


@pytest.mark.parametrize("parts", [7, None])
def test_running_sums_match_brute_force(spark, parts):
    rnd = random.Random(3)
    rows = [(g, x, rnd.randint(0, 5)) for g in "abc" for x in rnd.sample(range(200), 60)]
    df = spark.createDataFrame(rows, "g string, x long, v long")
    got = {(r["g"], r["x"]): r["v_below"]
           for r in ordering.running_sums_below(df, ["g"], "x", ["v"], parts=parts).collect()}
    for g, x, _ in rows:
        assert got[(g, x)] == sum(v for g2, x2, v in rows if g2 == g and x2 < x)


@pytest.mark.parametrize("parts", [5, None])
def test_dense_index_is_consecutive(spark, parts):
    df = spark.range(0, 1000).withColumn("k", (F.col("id") * 7919) % 1000)
    out = ordering.dense_index(df, ["k", "id"], name="pos", parts=parts, total_name="n").collect()
    by_pos = sorted(out, key=lambda r: r["pos"])
    assert [r["pos"] for r in by_pos] == list(range(1000))
    assert [r["k"] for r in by_pos] == sorted(r["k"] for r in out)
    assert {r["n"] for r in out} == {1000}


def test_bias_metrics_match_brute_force(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(400):
        s = rnd.choice([0.1, 0.2, 0.25, 0.5, 0.7, 0.9, rnd.random()])
        rows.append((i, s, rnd.random() < 0.3, rnd.random() < 0.2, rnd.random() < 0.5))
    df = spark.createDataFrame(rows, "id long, s double, y boolean, a boolean, b boolean")
    out = {r["subgroup"]: r for r in metrics.bias_metrics(df, {"a": "a", "b": "b", "none": F.lit(False)},
                                                          "y", "s", parts=3).collect()}
    for name, idx in [("a", 3), ("b", 4)]:
        sub = [(r[1], r[2]) for r in rows if r[idx]]
        bpsn = [(r[1], r[2]) for r in rows if (r[idx] and not r[2]) or (not r[idx] and r[2])]
        bnsp = [(r[1], r[2]) for r in rows if (r[idx] and r[2]) or (not r[idx] and not r[2])]
        assert out[name]["subgroup_size"] == len(sub)
        assert out[name]["subgroup_auc"] == pytest.approx(brute_auc(sub), abs=1e-12)
        assert out[name]["bpsn_auc"] == pytest.approx(brute_auc(bpsn), abs=1e-12)
        assert out[name]["bnsp_auc"] == pytest.approx(brute_auc(bnsp), abs=1e-12)
    empty = out["none"]
    assert empty["subgroup_size"] == 0 and empty["subgroup_auc"] is None
    assert empty["bpsn_auc"] is None and empty["bnsp_auc"] is None


def test_auc_complement(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([0.1, 0.3, 0.5, 0.8]), rnd.random() < 0.4) for _ in range(300)]
    df = spark.createDataFrame(rows, "s double, y boolean")
    a = metrics.auc(df, "s", "y").collect()[0]["auc"]
    b = metrics.auc(df, 1.0 - F.col("s"), "y").collect()[0]["auc"]
    assert a + b == pytest.approx(1.0, abs=1e-12)
    assert a == pytest.approx(brute_auc(rows), abs=1e-12)


def test_grouped_auc(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice("xyz"), rnd.random(), rnd.random() < 0.5) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, s double, y boolean")
    got = {r["g"]: r["auc"] for r in metrics.auc(df, "s", "y", by=["g"]).collect()}
    for g in "xyz":
        assert got[g] == pytest.approx(brute_auc([(s, y) for gg, s, y in rows if gg == g]), abs=1e-12)


def test_split_is_stable_and_sized(spark):
    df = spark.range(0, 20000)
    a = df.where(sample.split_flag(0.3)).count()
    b = df.repartition(13).where(sample.split_flag(0.3)).count()
    assert a == b
    assert 0.28 < a / 20000 < 0.32


def test_training_weights_values(spark):
    from biasframe.schema import SCORED_IDENTITIES
    from biasframe.sources.comments import comments
    df = comments(spark, "/root/testdata/sf0.001").where(F.col("target").isNotNull())
    vals = {r[0] for r in df.select(metrics.training_weight("target", SCORED_IDENTITIES)).distinct().collect()}
    assert vals <= {0.25, 0.5, 0.75, 1.0}


def test_hot_keys_stay_exact(spark):
    """A third of the rows share one score and one text: results stay exact."""
    from biasframe.operators import dedup
    rnd = random.Random(17)
    rows = []
    for i in range(3000):
        hot = i % 3 == 0
        s = 0.5 if hot else rnd.random()
        text = "same text" if hot else f"text {i}"
        rows.append((i, text, s, rnd.random() < 0.3, hot or rnd.random() < 0.1, 1 + i % 5))
    df = spark.createDataFrame(rows, "id long, comment_text string, s double, y boolean, a boolean, w int")
    out = metrics.bias_metrics(df, {"a": "a"}, "y", "s", parts=4).collect()[0]
    sub = [(r[2], r[3]) for r in rows if r[4]]
    bpsn = [(r[2], r[3]) for r in rows if (r[4] and not r[3]) or (not r[4] and r[3])]
    assert out["subgroup_auc"] == pytest.approx(brute_auc(sub), abs=1e-12)
    assert out["bpsn_auc"] == pytest.approx(brute_auc(bpsn), abs=1e-12)
    d = df.select("id", "comment_text", F.col("s").alias("target"), F.col("w").alias("toxicity_annotator_count"))
    got = {r["id"]: r["target"] for r in dedup.collapse_duplicates(d).collect()}
    hot_rows = [r for r in rows if r[1] == "same text"]
    want = sum(r[2] * r[5] for r in hot_rows) / sum(r[5] for r in hot_rows)
    assert len(got) == 2001 and got[0] == pytest.approx(want, abs=1e-9)
