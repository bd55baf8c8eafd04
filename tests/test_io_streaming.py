"""Round trips of the file sources/sinks and the streaming wiring."""

import os
import tempfile

from pyspark.sql import types as T

from biasframe.sources import files
from biasframe.streaming import scoring


def _tmp():
    return tempfile.mkdtemp(prefix="biasframe-test-", dir="/tmp")


def test_csv_quirks(spark):
    d = _tmp()
    p = os.path.join(d, "train.csv")
    with open(p, "w") as f:
        f.write('id,target,comment_text\n1,0.5,"line one\nline two"\n2,,"say ""hi"""\n3,NaN,\n')
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("target", T.DoubleType()),
                           T.StructField("comment_text", T.StringType())])
    rows = files.read_annotated_csv(spark, p, schema).orderBy("id").collect()
    assert rows[0]["comment_text"] == "line one\nline two"
    assert rows[1]["target"] is None and rows[1]["comment_text"] == 'say "hi"'
    assert rows[2]["target"] is None and rows[2]["comment_text"] is None


def test_word_vectors_round_trip_last_wins(spark):
    d = _tmp()
    p = os.path.join(d, "vec.txt")
    with open(p, "w") as f:
        f.write("a 1 2\nb 3 4\na 5 6 \n")
    v = {r["word"]: r["vector"] for r in files.read_word_vectors(spark, p).collect()}
    assert v == {"a": [5.0, 6.0], "b": [3.0, 4.0]}
    out = os.path.join(d, "out")
    files.write_word_vectors(files.read_word_vectors(spark, p), out)
    v2 = {r["word"]: r["vector"] for r in files.read_word_vectors(spark, out).collect()}
    assert v2 == v


def test_predictions_template_and_json(spark):
    d = _tmp()
    preds = spark.createDataFrame([(1, 0.2), (3, 0.9)], "id long, prediction double")
    template = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    filled = files.fill_template(template, preds)
    files.write_predictions(filled, os.path.join(d, "sub"))
    back = {r["id"]: r["prediction"] for r in files.read_predictions(spark, os.path.join(d, "sub")).collect()}
    assert back == {1: 0.2, 2: None, 3: 0.9}
    files.republish(spark, os.path.join(d, "sub"), os.path.join(d, "sub2"))
    assert files.read_predictions(spark, os.path.join(d, "sub2")).count() == 3
    tagged = spark.createDataFrame([(1, "male"), (2, "female"), (1, "female")], "id long, tag string")
    files.write_json(tagged, os.path.join(d, "tags"), partition_by="tag")
    assert {x for x in os.listdir(os.path.join(d, "tags")) if x.startswith("tag=")} == {"tag=female", "tag=male"}
    schema = T.StructType([T.StructField("id", T.LongType())])
    assert files.read_json_records(spark, os.path.join(d, "tags", "tag=female"), schema, multiline=False).count() == 2


def test_streaming_features(spark):
    d = _tmp()
    src = os.path.join(d, "in")
    spark.createDataFrame([(1, "Hi!!! :-( 42"), (2, "male female")], "id long, comment_text string") \
        .write.parquet(src)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("comment_text", T.StringType())])
    q = scoring.start(spark, src, schema, os.path.join(d, "out"), name="t_stream_" + os.path.basename(d))
    q.awaitTermination(120)
    out = {r["id"]: r for r in spark.read.parquet(os.path.join(d, "out")).collect()}
    assert out[1]["clean_text"] == "Hi    Sad 0"  # special chars go after the whitespace step
    assert out[2]["features_array"][4 + 13] == 2.0   # "male" occurs twice
    assert out[1]["features_array"][1] == 3.0         # longest "!" run


def test_csv_to_json_and_model_round_trip(spark):
    d = _tmp()
    p = os.path.join(d, "in.csv")
    with open(p, "w") as f:
        f.write("id,male,comment_text\n1,1.0,a\n2,0.0,b\n")
    files.csv_to_json(spark, p, os.path.join(d, "json"))
    rows = spark.read.json(os.path.join(d, "json")).orderBy("id").collect()
    assert [r["male"] for r in rows] == ["1.0", "0.0"]          # every value kept as a string
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    df = spark.createDataFrame([(0.0, 0.1), (1.0, 0.9), (0.0, 0.2), (1.0, 0.8)], "label double, x double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"),
                             LogisticRegression(maxIter=5)]).fit(df)
    files.save_model(model, os.path.join(d, "model"))
    back = files.load_pipeline_model(os.path.join(d, "model"))
    assert [r["prediction"] for r in back.transform(df).collect()] == [r["prediction"] for r in model.transform(df).collect()]


def test_flag_words_join(spark):
    from biasframe.operators.features import flag_words
    df = spark.createDataFrame([(1, "You are BAD"), (2, "fine"), (3, None)], "id long, t string")
    words = spark.createDataFrame([("bad",), ("worse",)], "word string")
    got = {r["id"]: r["has_word"] for r in flag_words(df, "id", "t", words).collect()}
    assert got == {1: True, 2: False, 3: False}
    from biasframe.functions.text import contains_any_word
    got2 = {r["id"]: r["f"] for r in df.select("id", contains_any_word("t", ["bad", "worse"]).alias("f")).collect()}
    assert got2 == got
