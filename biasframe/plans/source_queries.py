"""Queries for the file sources and sinks (A1-A11). Each writes the given tables
in the file's format to the shared folder, reads them back by the reader under
test, and must give the rows that went in."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from biasframe.functions.labels import at_least
from biasframe.operators import sample as H
from biasframe.operators.models import score, train_forest, with_vector
from biasframe.operators.ordering import materialize
from biasframe.operators.vocab import sentences
from biasframe.schema import SCORED_IDENTITIES, TOXICITY_PROJECTION
from biasframe.sources import files
from biasframe.sources.comments import comments, with_comments
from biasframe.sources.splits import scratch
from biasframe.sources.tables import table

ANNOTATED = ["id", "target", "comment_text", "male", "female", "likes", "article_id"]
TYPES = {"id": T.LongType(), "target": T.DoubleType(), "male": T.DoubleType(), "female": T.DoubleType(), "likes": T.IntegerType()}
SCHEMA = T.StructType([T.StructField(c, TYPES.get(c, T.StringType())) for c in ANNOTATED])
WORDS = 97


def _annotated(spark, sf_dir, encoding="UTF-8"):
    path = scratch(spark, "annotated")
    rows = comments(spark, sf_dir).select(ANNOTATED).withColumn(
        "comment_text", F.concat("comment_text", F.lit('\n"quoted", line')))  # every text has what a CSV reader may stumble on
    rows.write.option("header", True).option("escape", '"').option("encoding", encoding).csv(path)
    return path


_ANNOTATED_SQL = "SELECT id, target, {} AS comment_text, male, female, likes, article_id FROM comments"
_TEXT_SQL = "comment_text || chr(10) || '\"quoted\", line'"


def read_csv(spark, sf_dir):
    """A1."""
    return files.read_annotated_csv(spark, _annotated(spark, sf_dir), SCHEMA)


def read_csv_sql():
    return with_comments(_ANNOTATED_SQL.format(_TEXT_SQL))


def read_latin1(spark, sf_dir):
    """A2: what Latin-1 lacks was written as a question mark."""
    return files.read_annotated_csv(spark, _annotated(spark, sf_dir, "ISO-8859-1"), SCHEMA, "ISO-8859-1")


def read_latin1_sql():
    return with_comments(_ANNOTATED_SQL.format(f"regexp_replace({_TEXT_SQL}, '[^\\x00-\\xFF]', '?', 'g')"))


def csv_as_json(spark, sf_dir):
    """A3: every value stays the string it was in the file."""
    path = scratch(spark, "converted")
    files.csv_to_json(spark, _annotated(spark, sf_dir), path)
    back = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in ANNOTATED])).json(path)
    return back.select("id", "comment_text", "likes", "article_id", F.col("target").cast("double").alias("target_value"))


def csv_as_json_sql():
    return with_comments(f"SELECT id::VARCHAR AS id, {_TEXT_SQL} AS comment_text, likes::VARCHAR AS likes, article_id, target AS target_value FROM comments")


def read_json_array(spark, sf_dir):
    """A4 + A6: arrays of records."""
    path = scratch(spark, "projection")
    rows = comments(spark, sf_dir).select(*TOXICITY_PROJECTION)
    files.write_json_arrays(rows, path)
    return files.read_json_records(spark, path, rows.schema)


def read_json_array_sql():
    return with_comments(f"SELECT {', '.join(TOXICITY_PROJECTION)} FROM comments")


def tag_files(spark, sf_dir):
    """A5 (+ J4): one JSON folder per tag, read back with the tag of the folder."""
    path = scratch(spark, "tags")
    rows = comments(spark, sf_dir).select("id", "target", F.explode(F.array_compact(F.array(
        *[F.when(at_least(c, 0.5), F.lit(c)) for c in SCORED_IDENTITIES]))).alias("tag"))
    files.write_json(rows, path, partition_by="tag")
    return spark.read.schema("id long, target double, tag string").json(path)


def tag_files_sql():
    return with_comments("\nUNION ALL ".join(f"SELECT id, target, '{c}' AS tag FROM comments WHERE {c} >= 0.5e0" for c in SCORED_IDENTITIES))


def sentence_corpus(spark, sf_dir):
    """The sentence corpus as arrays of token lists, written and read back."""
    path = scratch(spark, "sentences")
    turns = table(spark, sf_dir, "conversations").select(F.explode(sentences("text")).alias("sentence"))
    files.write_json_arrays(turns.select(F.split("sentence", " ").alias("tokens")), path)
    back = files.read_json_lists(spark, path)
    return back.groupBy(F.array_join("tokens", " ").alias("sentence")).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("tokens")).alias("n_tokens"))


def sentence_corpus_sql():
    return r"""
WITH marked AS (SELECT regexp_replace(coalesce(text, ''), '([.!?])[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', '\1' || chr(1), 'g') AS t FROM conversations),
s AS (SELECT unnest(string_split(t, chr(1))) AS sentence FROM marked)
SELECT sentence, count(*) AS n, max(len(string_split(sentence, ' ')))::INTEGER AS n_tokens FROM s WHERE trim(sentence, ' ') <> '' GROUP BY sentence"""


def word_vectors(spark, sf_dir):
    """Every word stands in several lines, the last of which holds."""
    path = scratch(spark, "vectors")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("w"), (F.col("vec_id") % WORDS).cast("string")).alias("word"), F.col("embedding").alias("vector"))
    files.write_word_vectors(rows.repartitionByRange("vec_id").sortWithinPartitions("vec_id"), path)
    return files.read_word_vectors(spark, path).select("word", F.transform("vector", lambda x: F.round(x.cast("double"), 6)).alias("vector"))


def word_vectors_sql():
    return f"""SELECT 'w' || (vec_id % {WORDS}) AS word, list_transform(arg_max(embedding, vec_id), lambda x: round(x::DOUBLE, 6)) AS vector
FROM embeddings GROUP BY vec_id % {WORDS}"""


def _predictions(spark, sf_dir):
    return comments(spark, sf_dir).where("score IS NOT NULL").select("id", F.col("score").alias("prediction"))


def predictions_file(spark, sf_dir):
    """A8 + A10: written, published again with its ids checked, and read."""
    first, second = scratch(spark, "predictions"), scratch(spark, "published")
    files.write_predictions(_predictions(spark, sf_dir), first)
    files.republish(spark, first, second)
    return files.read_predictions(spark, second)


def predictions_file_sql():
    return with_comments("SELECT id, score AS prediction FROM comments WHERE score IS NOT NULL")


def filled_template(spark, sf_dir):
    """Every id of the template, with its prediction where there is one."""
    path = scratch(spark, "submission")
    template = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    files.write_predictions(files.fill_template(template, _predictions(spark, sf_dir)), path)
    return files.read_predictions(spark, path)


def filled_template_sql():
    return with_comments("SELECT id, score AS prediction FROM comments")


def repeated_ids(spark, sf_dir):
    """A10: the ids for which a file of predictions would be refused, with their
    numbers of rows (the predictions, and those of approved rows once more)."""
    path = scratch(spark, "repeated")
    some = comments(spark, sf_dir).where("score IS NOT NULL AND rating = 'approved'").select("id", F.col("score").alias("prediction"))
    files.write_predictions(_predictions(spark, sf_dir).unionByName(some), path)
    return files.repeated(files.read_predictions(spark, path))


def repeated_ids_sql():
    return with_comments("SELECT id, 2::BIGINT AS n FROM comments WHERE score IS NOT NULL AND rating = 'approved'")


def model_round_trip(spark, sf_dir):
    """Scores of a fitted model and of the same model saved and loaded."""
    data = comments(spark, sf_dir).where("target IS NOT NULL").select(
        "id", F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in SCORED_IDENTITIES], F.length("comment_text").cast("double")).alias("_x"),
        at_least("target", 0.5).cast("double").alias("label"), H.split_flag(0.3).alias("is_test"))
    data = materialize(with_vector(data, "_x").drop("_x"))
    model, path = train_forest(data.where("NOT is_test"), "label", num_trees=20, max_depth=5, seed=11), scratch(spark, "model")
    files.save_model(model, path)
    one = score(model, data.where("is_test")).select("id", F.col("prediction_score").alias("_a"))
    two = score(files.load_model(path), data.where("is_test")).select("id", F.col("prediction_score").alias("_b"))
    return one.join(two, "id").select("id", (F.col("_a") == F.col("_b")).alias("same"))


def model_round_trip_sql():
    return with_comments(f"SELECT id, true AS same FROM comments WHERE target IS NOT NULL AND {H.row_hash_sql('split')} < {int(0.3 * H.TWO_32)}")


QUERIES = {
    "a1_read_csv": (read_csv, read_csv_sql),
    "a2_read_latin1": (read_latin1, read_latin1_sql),
    "a3_csv_to_json": (csv_as_json, csv_as_json_sql),
    "a4_a6_json_arrays": (read_json_array, read_json_array_sql),
    "a5_tag_files": (tag_files, tag_files_sql),
    "a6_sentence_corpus": (sentence_corpus, sentence_corpus_sql),
    "a7_word_vectors": (word_vectors, word_vectors_sql),
    "a8_a10_predictions": (predictions_file, predictions_file_sql),
    "a9_template": (filled_template, filled_template_sql),
    "a10_repeated_ids": (repeated_ids, repeated_ids_sql),
    "a11_model_round_trip": (model_round_trip, model_round_trip_sql),
}
