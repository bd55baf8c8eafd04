"""Hand-checked tiny tables (the cases the provided tables lack)."""

import math

import pytest
from pyspark.sql import functions as F

from biasframe.functions import labels as L
from biasframe.functions import text as X
from biasframe.operators import dedup, explore, metrics, sample, vocab

def test_auc_ties(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0), (0.5, 1)], "s double, y int")
    v = metrics.auc(df, "s", F.col("y") == 1).collect()[0]["auc"]
    assert v == pytest.approx(0.8333333333, abs=1e-9)


def test_auc_one_class_is_null(spark):
    df = spark.createDataFrame([(0.2, 1), (0.7, 1)], "s double, y int")
    assert metrics.auc(df, "s", F.col("y") == 1).collect()[0]["auc"] is None


def test_threshold_nan_null(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, 0.5), (4, 0.4999)], "i int, v double")
    got = [r["b"] for r in df.select(L.at_least("v", 0.5).alias("b")).orderBy(F.col("i")).collect()]
    assert got == [False, False, True, False]


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("o")).collect()[0]["o"]


def test_emoticons(spark):
    assert _one(spark, X.clean_emoticons, "a<3b") == "a Love b"
    assert _one(spark, X.clean_emoticons, ":*") == " Love "
    for w in [";-)", ";D", "(-;", ";)"]:
        assert _one(spark, X.clean_emoticons, w) == " Wink ", w
    for s in [":(", ": (", ":-(", ") :", ")-:", "):"]:
        assert _one(spark, X.clean_emoticons, s) == " Sad ", s


def test_whitespace(spark):
    assert _one(spark, X.collapse_whitespace, " a\tb\nc\rd\u00a0e  f ") == "a b c d e f"
    assert _one(spark, X.word_count, " a\tb\u00a0c ") == 3
    assert _one(spark, X.word_count, "") == 0
    assert _one(spark, X.space_split_count, "a  b") == 3


def test_negation(spark):
    assert _one(spark, X.clean_negation, "don't can't") == "donot canot"


def test_special_chars(spark):
    assert len(X.PUNCTUATION) == 64 and len(X.SPECIAL_CHARS) == 58
    assert sorted(X.REPEATED_SPECIAL_CHARS) == sorted("/-'\\`\"")
    assert _one(spark, X.clean_special_chars, "a/b\\c×d") == "a b c d"
    # Each repeated character counts twice
    assert _one(spark, X.punctuation_count, "/a-b") == 4
    assert _one(spark, X.punctuation_count, "?") == 1
    assert _one(spark, X.punctuation_count, X.SPECIAL_CHARS) == 64


def test_runs(spark):
    t = "a!!b!!! **"
    assert [_one(spark, lambda c, ch=ch: X.longest_run(c, ch), t) for ch in "!*."] == [3, 2, 0]


def test_substring_count(spark):
    assert _one(spark, lambda c: X.substring_count(c, "male"), "female male") == 2
    assert _one(spark, lambda c: X.substring_count(c, "female"), "female male") == 1
    assert _one(spark, lambda c: X.substring_count(c, "male", whole_word=True), "female male, male_x") == 1


def test_numbers_urls(spark):
    assert _one(spark, X.clean_numbers, "a 123 b 4") == "a 0 b 0"
    assert _one(spark, X.clean_urls, "see http://a.b/c?d=1 ok") == "see  ok"


def test_vocabulary_ties(spark):
    docs = spark.createDataFrame([(1, "b a"), (2, "a b")], "id long, text string")
    v = vocab.fit_vocabulary(vocab.corpus([docs]))
    got = {r["word"]: r["word_index"] for r in v.collect()}
    assert got == {"b": 1, "a": 2}


def test_padding(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "ids array<int>")
    r = df.select(vocab.pad_post("ids", 5).alias("a"), vocab.pad_pre("ids", 5).alias("b"),
                  vocab.pad_pre("ids", 2).alias("c"), vocab.pad_post("ids", 2).alias("d")).collect()[0]
    assert r["a"] == [1, 2, 3, 0, 0]
    assert r["b"] == [0, 0, 1, 2, 3]
    assert r["c"] == [2, 3]
    assert r["d"] == [2, 3]


def test_duplicates(spark):
    df = spark.createDataFrame([(5, "x", 0.0, 1), (3, "x", 1.0, 3), (7, "y", 0.2, 0), (8, "y", 0.4, 0)],
                               "id long, comment_text string, target double, toxicity_annotator_count int")
    out = {r["id"]: r["target"] for r in dedup.collapse_duplicates(df).collect()}
    assert out == {3: 0.75, 7: None}
    # idempotent
    again = dedup.collapse_duplicates(dedup.collapse_duplicates(df)).orderBy("id").collect()
    assert [(r["id"], r["target"]) for r in again] == [(3, 0.75), (7, None)]


def test_empty_and_null_text(spark):
    df = spark.createDataFrame([(1, ""), (2, None)], "id long, text string")
    r = df.select(X.whitespace_tokens(X.as_text("text")).alias("t")).collect()
    assert [x["t"] for x in r] == [[], []]
    v = vocab.encode(df, spark.createDataFrame([("a", 1)], "word string, word_index long"))
    assert [x["ids"] for x in v.orderBy("id").collect()] == [[], []]


def test_histogram(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 3, 4]], "v double")
    h = explore.histogram(df, "v", 2).orderBy("bin").collect()
    assert [r["count"] for r in h] == [2, 3]
    assert (h[0]["bin_lo"], h[1]["bin_hi"]) == (0.0, 4.0)


def test_power_mean_and_final(spark):
    bias = spark.createDataFrame([("a", 1, 0.8, 0.9, 0.7), ("b", 1, 0.6, 0.5, 0.9)],
                                 "subgroup string, subgroup_size long, subgroup_auc double, bpsn_auc double, bnsp_auc double")
    overall = spark.createDataFrame([(0.75,)], "overall_auc double")
    r = metrics.final_metric(bias, overall, digits=None).collect()[0]

    def pm(xs):
        return (sum(x ** -5 for x in xs) / len(xs)) ** (-1 / 5)
    want = 0.25 * 0.75 + 0.75 * (pm([0.8, 0.6]) + pm([0.9, 0.5]) + pm([0.7, 0.9])) / 3
    assert math.isclose(r["final_metric"], want, rel_tol=1e-12)


def test_softmax(spark):
    df = spark.createDataFrame([(math.log(0.25), math.log(0.75))], "a double, b double")
    assert df.select(L.softmax_positive("a", "b")).collect()[0][0] == pytest.approx(0.75)


def test_java_whitespace_class_is_python_isspace(spark):
    chars = [chr(i) for i in range(0, 0x3100) if not 0xD800 <= i <= 0xDFFF]
    df = spark.createDataFrame([(i, ch) for i, ch in enumerate(chars)], "i int, ch string")
    got = {r["i"]: r["m"] for r in df.select("i", F.col("ch").rlike("(?U)^" + X.JAVA_WS + "$").alias("m")).collect()}
    assert all(got[i] == ch.isspace() for i, ch in enumerate(chars))


def test_missing_prediction_counts_as_wrong(spark):
    from biasframe.operators import metrics
    df = spark.createDataFrame([(1, 1), (None, 1), (0, 0), (1, None)], "p int, y int")
    assert metrics.accuracy(df, "p", "y").first()[0] == pytest.approx(2 / 3)


def test_forest_depth_beyond_the_limit_raises(spark):
    from biasframe.operators import models
    with pytest.raises(ValueError):
        models.train_forest(spark.range(1), "id", max_depth=31)


def test_null_texts_are_duplicates_of_nothing(spark):
    df = spark.createDataFrame([(0, "a", 0.2, 1), (1, None, 0.4, 1), (2, None, 0.6, 1), (3, "b", 0.8, 1), (4, "a", 0.4, 1)],
                               "id long, comment_text string, target double, toxicity_annotator_count int")
    assert sorted(r["id"] for r in dedup.find_duplicates(df).collect()) == [0, 4]
    kept = {r["id"]: r["target"] for r in dedup.collapse_duplicates(df).collect()}
    assert {k: round(v, 6) for k, v in kept.items()} == {0: 0.3, 1: 0.4, 2: 0.6, 3: 0.8}
    assert {r["id"]: r["n_removed_before"] for r in dedup.removed_before(df).collect()} == {0: 0, 1: 0, 2: 0, 3: 0}


def test_sample_then_split_keeps_both_sides(spark):
    ids = spark.range(10000)
    train, test = sample.train_test_split(sample.sample_n(ids, 1000), 0.2)
    assert 150 < test.count() < 250 and 750 < train.count() < 850
    a, b = ({r["id"] for r in ids.where(sample.split_flag(0.2, seed=s)).collect()} for s in (0, 1))
    assert 300 < len(a & b) < 500 and len({x + 1 for x in a} & b) < 500  # independent: 4 % of the rows
