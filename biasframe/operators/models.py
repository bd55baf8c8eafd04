"""Distributed training and scoring with Spark ML.

Training runs as Spark ML jobs (per-partition statistics, tree-aggregated);
scoring is ``transform`` (JVM side). Models from other libraries are scored
with ``mapInPandas``, loading the model once per task.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_vector(df: DataFrame, array_col: str, out: str = "features") -> DataFrame:
    """array<double> -> ML vector (JVM-side conversion)."""
    return df.withColumn(out, array_to_vector(F.col(array_col).cast("array<double>")))


def train_forest(df: DataFrame, label: str, features: str = "features", num_trees: int = 100,
                 max_depth: int = 10, seed: int = 0, weight: str | None = None, **params):
    """L1: random forest for one 0/1 label (Spark allows depths up to 30)."""
    if max_depth > 30:
        raise ValueError("Spark's trees have a depth of at most 30")
    rf = RandomForestClassifier(labelCol=label, featuresCol=features, numTrees=num_trees,
                                maxDepth=max_depth, seed=seed, **params)
    if weight:
        rf = rf.setWeightCol(weight)
    return rf.fit(df)


def sample_grid(estimator: Estimator, space: Mapping[str, Sequence], n_iter: int, seed: int = 0):
    """L2: a seeded random sample of ``n_iter`` parameter maps from the grid."""
    b = ParamGridBuilder()
    for name, values in space.items():
        b = b.addGrid(estimator.getParam(name), list(values))
    grid = b.build()
    rnd = random.Random(seed)
    return grid if n_iter >= len(grid) else rnd.sample(grid, n_iter)


def random_search(estimator: Estimator, df: DataFrame, space: Mapping[str, Sequence], n_iter: int,
                  label: str, fold_col: str, seed: int = 0, parallelism: int = 2,
                  metric: str = "areaUnderROC"):
    """L2: random search with k-fold cross-validation on a fold column
    (``sample.fold_column``), scored by AUC."""
    ev = BinaryClassificationEvaluator(labelCol=label, metricName=metric)
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=sample_grid(estimator, space, n_iter, seed),
                        evaluator=ev, foldCol=fold_col, parallelism=parallelism, seed=seed)
    return cv.fit(df)


def feature_importances(spark, model, names: Sequence[str]) -> DataFrame:
    """L3: (index, name, weight) - one small row per feature."""
    w = model.featureImportances.toArray().tolist()
    return spark.createDataFrame([(i, n, float(v)) for i, (n, v) in enumerate(zip(names, w))],
                                 "index int, name string, weight double")


def train_multilabel(df: DataFrame, labels: Sequence[str], features: str = "features",
                     weight: str | None = None, max_iter: int = 50, reg: float = 0.0) -> dict:
    """L4 (re-aimed): one logistic model per label. The reference network has no
    hidden activation, so it is a low-rank multi-label logistic model."""
    models = {}
    for lab in labels:
        lr = LogisticRegression(labelCol=lab, featuresCol=features, maxIter=max_iter, regParam=reg,
                                predictionCol=f"{lab}_pred", probabilityCol=f"{lab}_prob",
                                rawPredictionCol=f"{lab}_raw")
        if weight:
            lr = lr.setWeightCol(weight)
        models[lab] = lr.fit(df)
    return models


def positive_probability(prob_col: str = "probability") -> Column:
    """Probability of class 1 from an ML probability vector."""
    return vector_to_array(F.col(prob_col))[1]


def score(model, df: DataFrame, out: str = "prediction_score") -> DataFrame:
    """Class and probability of class 1."""
    return model.transform(df).withColumn(out, positive_probability(model.getProbabilityCol()))


def score_foreign(df: DataFrame, load: Callable[[], object], predict: Callable, out_schema: T.StructType) -> DataFrame:
    """L5 for a model of another library: ``load()`` runs once per task,
    ``predict(model, pandas_frame) -> pandas_frame`` per Arrow batch."""
    def run(batches):
        model = load()
        for pdf in batches:
            yield predict(model, pdf)
    return df.mapInPandas(run, out_schema)
