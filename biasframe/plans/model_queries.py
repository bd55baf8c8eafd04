"""Queries for training, scoring and publishing (L1-L8, G5-G8) and the input
volume report (A12). Seeded training has no SQL form: the driver checks
these by rows only."""

from __future__ import annotations

from pyspark.sql import functions as F

from biasframe.functions import text as X
from biasframe.functions.labels import as_class, at_least
from biasframe.operators import embed as G
from biasframe.operators import metrics as M
from biasframe.operators import models as ML
from biasframe.operators import sample as H
from biasframe.operators import sketch_vectors as SV
from biasframe.operators import vocab as V
from biasframe.operators.features import FEATURE_NAMES, feature_columns
from biasframe.operators.joint_logit import fit
from biasframe.operators.ordering import attach_row, materialize, spread, stored
from biasframe.plans.bias_report import labelled, subgroup_flags
from biasframe.plans.text_queries import FLAG_WORDS
from biasframe.schema import SCORED_IDENTITIES, SUBTYPE_COLUMNS
from biasframe.sources.comments import comments, with_comments
from biasframe.sources.files import fill_template, volume_report
from biasframe.sources.tables import TABLES, table

FOREST = {"num_trees": 100, "max_depth": 10, "seed": 7}


def _feature_frame(df):
    cols = feature_columns(F.col("noisy_text"), FLAG_WORDS)
    d = df.withColumn("_feats", F.array(*[c.cast("double") for c in cols]))
    return ML.with_vector(d, "_feats").drop("_feats")


def _train_frame(spark, sf_dir):
    d = _feature_frame(labelled(spark, sf_dir)).withColumn("label", as_class("target").cast("double"))
    return d.withColumn("is_test", H.split_flag(0.3))


def forest_scores(spark, sf_dir):
    """L1 + L5: forest on the 30 text features, scores of the held-out rows."""
    d = _train_frame(spark, sf_dir)
    model = ML.train_forest(d.where(~F.col("is_test")), "label", **FOREST)
    s = ML.score(model, d.where(F.col("is_test")))
    return s.select("id", "label", F.col("prediction").alias("pred_class"), "prediction_score")


def importances(spark, sf_dir):
    """L3."""
    d = _train_frame(spark, sf_dir)
    model = ML.train_forest(d.where(~F.col("is_test")), "label", **FOREST)
    return ML.feature_importances(spark, model, FEATURE_NAMES)


def random_search(spark, sf_dir):
    """L2: 10 draws of the 64 grid points, 3 folds on a hash fold column, by AUC."""
    from pyspark.ml.classification import RandomForestClassifier
    d = materialize(_train_frame(spark, sf_dir).withColumn("fold", H.fold_column(3))
                    .select("id", "features", "label", "fold"))
    est = RandomForestClassifier(labelCol="label", featuresCol="features", seed=7)
    space = {"numTrees": [20, 50, 100, 200], "maxDepth": [5, 10], "featureSubsetStrategy": ["sqrt", "log2"],
             "impurity": ["gini", "entropy"], "minInstancesPerNode": [1, 4]}
    cv = ML.random_search(est, d, space, n_iter=10, label="label", fold_col="fold", seed=0, parallelism=4)
    rows = [(str({p.name: v for p, v in pm.items()}), float(m))
            for pm, m in zip(cv.getEstimatorParamMaps(), cv.avgMetrics)]
    return spark.createDataFrame(rows, "params string, mean_auc double")


def multilabel(spark, sf_dir):
    """L4: the target and the 5 subtypes fitted together, one scan an iteration,
    to convergence."""
    labels = ["target", *SUBTYPE_COLUMNS]
    feats = F.array(*[c.cast("double") for c in feature_columns(F.col("noisy_text"), FLAG_WORDS)])
    d = labelled(spark, sf_dir).select("id", feats.alias("features"), M.training_weight("target", SCORED_IDENTITIES).alias("w"),
                                       *[as_class(c).cast("double").alias(f"y_{c}") for c in labels])
    d = stored(d)  # scanned once an iteration
    model = fit(d, [f"y_{c}" for c in labels], weight="w")
    return d.select("id", *[model.score(f"y_{c}").alias(f"p_{c}") for c in labels])


def train_evaluate(spark, sf_dir):
    """L6 + L7: train on the split, score the hold-out, and the whole report: the
    bias table of the model's scores, with overall AUC, power means, final
    metric, accuracy, loss and F1."""
    d = _train_frame(spark, sf_dir)
    model = ML.train_forest(d.where(~F.col("is_test")), "label", **FOREST)
    s = stored(ML.score(model, d.where(F.col("is_test"))).drop("features", "rawPrediction", "probability"))
    bias, report = M.training_report(s, subgroup_flags(), at_least("target", 0.5), "prediction_score")
    return attach_row(bias, report)


def submission(spark, sf_dir):
    """Score the unlabelled documents and fill the id template."""
    d = _train_frame(spark, sf_dir)
    model = ML.train_forest(d, "label", **FOREST)
    allc = comments(spark, sf_dir)
    test = _feature_frame(allc.where(F.col("target").isNull()))
    preds = ML.score(model, test).select("id", F.col("prediction_score").alias("prediction"))
    template = allc.where(F.col("target").isNull()).select("id")
    return fill_template(template, preds)


def submission_ids(spark, sf_dir):
    """What can be told of a submission without the model: its ids, each once,
    and predictions that are probabilities."""
    rows = submission(spark, sf_dir)
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min((F.col("prediction") >= 0) & (F.col("prediction") <= 1)).alias("is_probability"))


def submission_ids_sql():
    return with_comments("SELECT id, 1::BIGINT AS n, true AS is_probability FROM comments WHERE target IS NULL")


def forest_checks(spark, sf_dir):
    """L1 + L5: the held-out ids, and that the class is the likelier one."""
    s = forest_scores(spark, sf_dir)
    return s.select("id", "label", ((F.col("pred_class") == 1) == (F.col("prediction_score") > 0.5)).alias("class_fits"))


def forest_checks_sql():
    return with_comments(f"SELECT id, (target >= 0.5e0)::DOUBLE AS label, true AS class_fits FROM comments WHERE target IS NOT NULL "
                         f"AND {H.row_hash_sql('split')} < {int(0.3 * H.TWO_32)}")


def importance_checks(spark, sf_dir):
    """L3: one weight a feature, none negative, 1 in all."""
    return importances(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.min(F.col("weight") >= 0).alias("no_negative"), F.round(F.sum("weight"), 9).alias("total"))


def importance_checks_sql():
    return f"SELECT {len(FEATURE_NAMES)}::BIGINT AS n, true AS no_negative, 1.0::DOUBLE AS total"


FOREIGN = {"likes": 0.25, "funny": -0.5, "sad": 0.125}


def foreign_scores(spark, sf_dir):
    """A model of another library (here a few weights in a dictionary),
    loaded once a task, scoring Arrow batches."""
    import numpy as np
    import pandas as pd

    def predict(model, frame):
        z = sum(w * frame[c] for c, w in model.items()) - 0.5
        return pd.DataFrame({"id": frame["id"], "prediction": np.round(1 / (1 + np.exp(-z)), 9)})

    rows = comments(spark, sf_dir).select("id", *FOREIGN)
    return ML.score_foreign(rows, lambda: FOREIGN, predict, "id long, prediction double")


def foreign_scores_sql():
    z = " + ".join(f"{w}e0 * {c}" for c, w in FOREIGN.items())
    return with_comments(f"SELECT id, round(1 / (1 + exp(-({z} - 0.5e0))), 9) AS prediction FROM comments")


SENTENCE_DIM, SENTENCE_WINDOW, DOC_DIM, DOC_WINDOW = 60, 50, 300, 10
SKETCH_WIDTH = 48


def _conv_tokens(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
                    V.tokens(X.clean("text"), V.NEWLINE_TAB_FILTERS).alias("words"))


def _doc_tokens(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    return stored(docs.select("id", V.tokens(X.clean("text"), V.NEWLINE_TAB_FILTERS).alias("words")))


def word_sketches(spark, sf_dir):
    """The whole-number part of the factorisation, on conversation turns."""
    c = table(spark, sf_dir, "conversations").select("text")
    return SV.word_sketches(c.select(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " ").alias("words")), "words", SKETCH_WIDTH, DOC_WINDOW)


def word_sketches_sql():
    docs = "SELECT row_number() OVER () AS id, string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ') AS words FROM conversations"
    return SV.sketches_sql(docs, SKETCH_WIDTH, DOC_WINDOW)


def document_vectors(spark, sf_dir):
    """G5 + G7: vectors of 300 numbers for the document texts."""
    docs = _doc_tokens(spark, sf_dir)
    return SV.document_vectors(SV.train(docs, dim=DOC_DIM, window=DOC_WINDOW), docs)


def sentence_vectors(spark, sf_dir):
    """Vectors of 60 numbers, window 50, trained on the sentences (F2) of the
    conversation turns and of the documents."""
    turns = table(spark, sf_dir, "conversations").select("text").unionByName(table(spark, sf_dir, "documents").select("text"))
    rows = stored(turns.select(F.explode(V.sentences("text")).alias("s")).select(X.whitespace_tokens(F.lower("s")).alias("words")))
    space = SV.train(rows, dim=SENTENCE_DIM, window=SENTENCE_WINDOW)
    return SV.document_vectors(space, _conv_tokens(spark, sf_dir))


def vector_fallback(spark, sf_dir):
    """Own split's vector, else the other split's, else inferred: the training
    split has its own vectors, half of the test split those of the test space."""
    docs = _doc_tokens(spark, sf_dir).withColumn("is_test", H.split_flag(0.3))
    train, test = docs.where(~F.col("is_test")), docs.where(F.col("is_test") & (F.col("id") % 2 == 0))
    space = SV.train(train, dim=SENTENCE_DIM, window=DOC_WINDOW)
    own, inferred = (SV.document_vectors(space, d.select("id", "words")) for d in (train, docs))
    other = SV.document_vectors(SV.train(test, dim=SENTENCE_DIM, window=DOC_WINDOW), test.select("id", "words"))
    return G.lookup_with_fallback(docs.select("id"), own, other, inferred).select("id", "vector")


def vector_sources(spark, sf_dir):
    """Which of the three an id's vector comes from; the vectors are told apart by
    their first number, as each source marks its own."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).withColumn("is_test", H.split_flag(0.3))

    def marked(rows, mark):
        return rows.select("id", F.array(F.lit(mark), F.col("id").cast("double")).alias("vector"))

    rows = G.lookup_with_fallback(docs.select("id"), marked(docs.where(~F.col("is_test")), 1.0), marked(docs.where(F.col("id") % 2 == 0), 2.0), marked(docs, 3.0))
    return rows.select("id", "vector")


def vector_sources_sql():
    test = f"{H.row_hash_sql('split', 'doc_id')} < {int(0.3 * H.TWO_32)}"
    return f"SELECT doc_id AS id, [CASE WHEN NOT ({test}) THEN 1 WHEN doc_id % 2 = 0 THEN 2 ELSE 3 END::DOUBLE, doc_id::DOUBLE] AS vector FROM documents"


def volume(spark, sf_dir):
    """Rows and columns of every input table."""
    return volume_report(spark, {t: table(spark, sf_dir, t) for t in TABLES})


def volume_sql():
    parts = [f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n_rows, "
             f"(SELECT CAST(count(*) AS BIGINT) FROM information_schema.columns WHERE table_name = '{t}') AS n_columns"
             for t in TABLES]
    return " UNION ALL ".join(parts)


QUERIES = {
    "l1_l5_forest_scores": (forest_scores, None),
    "l2_random_search": (random_search, None),
    "l3_feature_importances": (importances, None),
    "l4_multilabel_logistic": (multilabel, None),
    "l6_l7_train_evaluate_bias": (train_evaluate, None),
    "l8_submission": (submission, None),
    "l8_submission_ids": (submission_ids, submission_ids_sql),
    "l1_l5_forest_checks": (forest_checks, forest_checks_sql),
    "l3_importance_checks": (importance_checks, importance_checks_sql),
    "l5_foreign_scores": (foreign_scores, foreign_scores_sql),
    "g5_word_sketches": (word_sketches, word_sketches_sql),
    "g5_g7_document_vectors": (document_vectors, None),
    "g6_sentence_vectors": (sentence_vectors, None),
    "g8_vector_sources": (vector_sources, vector_sources_sql),
    "g8_vector_fallback": (vector_fallback, None),
    "a12_volume_report": (volume, volume_sql),
}
