"""The reference's baseline workflow end to end, Spark-first.

labelled comments -> booleans (B5) -> 80/20 hash split (H3) -> vocabulary on
the training texts, capped at 10,000 words (F5, F6) -> sequences, last 250
ids (F8, F11) -> word vectors by vocabulary rank (G1) -> document vector =
mean of its word vectors (ML ``Summarizer``) -> logistic model (re-aimed from
the reference's Conv1D network) -> scores of the validation rows (L5) -> bias
table, overall AUC and final metric (K5-K8).
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biasframe.functions.labels import at_least
from biasframe.operators import embed as G
from biasframe.operators import metrics as M
from biasframe.operators import sample as H
from biasframe.operators import vocab as V
from biasframe.operators.gather import mean_parts
from biasframe.operators.models import positive_probability
from biasframe.operators.ordering import materialize, stored
from biasframe.schema import SCORED_IDENTITIES
from biasframe.sources.comments import comments
from biasframe.sources.tables import table

MAX_NUM_WORDS = 10000
MAX_SEQUENCE_LENGTH = 250
VALIDATION_SHARE = 0.2


def document_vectors(seqs: DataFrame, vectors: DataFrame, dim: int, ids: str = "padded") -> DataFrame:
    """(id, features): mean word vector of each sequence. Padding is skipped;
    vocabulary words without a vector count with the zero row of the matrix
    (as in the reference's embedding matrix); no ids left -> zero vector."""
    means = mean_parts(seqs.select("id", F.filter(ids, lambda i: i > 0).alias(ids)), ids, vectors, dim).groupBy("id").agg(
        Summarizer.mean(array_to_vector("_mean"), F.col("_n")).alias("features"))
    zero = array_to_vector(F.array_repeat(F.lit(0.0), dim))
    return (seqs.select("id").join(means, "id", "left")
                .select("id", F.coalesce(F.col("features"), zero).alias("features")))


def baseline_workflow(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Returns (bias table, final-metric row) of the validation split."""
    rows = comments(spark, sf_dir, with_time=False).where(F.col("target").isNotNull())
    rows = rows.select("id", F.col("comment_text").alias("text"), "target", "score", *SCORED_IDENTITIES)
    rows = stored(rows)  # joined once, read by the vocabulary, the encoding and the fit
    is_valid = H.split_flag(VALIDATION_SHARE)
    train = rows.where(~is_valid)
    vocab = V.fit_vocabulary(V.corpus([train]), V.DEFAULT_FILTERS)
    seqs = V.encode(rows, vocab, num_words=MAX_NUM_WORDS)
    seqs = stored(seqs.select("id", V.pad_pre("ids", MAX_SEQUENCE_LENGTH).alias("padded")))
    emb = table(spark, sf_dir, "embeddings")
    dim = len(emb.select("embedding").first()[0])  # one row: the vector width
    matrix = G.embedding_matrix(vocab.where(F.col("word_index") < MAX_NUM_WORDS),
                                G.vectors_by_rank(emb, vocab), dim)
    feats = document_vectors(seqs, matrix, dim)
    data = materialize(rows.drop("text").join(feats, "id").withColumn("label", at_least("target", 0.5).cast("double"))
                       .withColumn("is_valid", is_valid))
    model = LogisticRegression(featuresCol="features", labelCol="label", maxIter=20).fit(data.where(~F.col("is_valid")))
    scored = model.transform(data.where(F.col("is_valid"))).withColumn("prediction_score", positive_probability())
    flags = {c: at_least(c, 0.5) for c in SCORED_IDENTITIES}
    bias, overall = M.bias_report(scored, flags, at_least("target", 0.5), "prediction_score")
    return bias, M.final_metric(bias, overall)


def baseline_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline_workflow(spark, sf_dir)[1]


QUERIES = {
    "baseline_bias_workflow": (baseline_final, None),
}
