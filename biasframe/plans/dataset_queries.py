"""Queries for duplicates, tag partitioning, set operations (J) and sampling (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from biasframe.functions.labels import at_least
from biasframe.operators import dedup as D
from biasframe.operators import partition as P
from biasframe.operators import sample as H
from biasframe.schema import IDENTITY_COLUMNS, TOXICITY_PROJECTION
from biasframe.sources.comments import comments, with_comments
from biasframe.sources.tables import table

def _proj_sql(prefix: str = "") -> str:
    return ", ".join(f"{prefix}{c}" for c in TOXICITY_PROJECTION)


# ------------------------------------------------------------------ J queries
def find_duplicates(spark, sf_dir):
    return D.find_duplicates(comments(spark, sf_dir)).select("id", "lang", "article_id")


def find_duplicates_sql():
    return with_comments("SELECT id, lang, article_id FROM comments WHERE comment_text IN "
                         "(SELECT comment_text FROM comments GROUP BY comment_text HAVING count(*) > 1)")


def collapse(spark, sf_dir):
    c = comments(spark, sf_dir).select("id", "comment_text", "target", "toxicity_annotator_count", "lang")
    return D.collapse_duplicates(c).select("id", "target", "toxicity_annotator_count", "lang")


def collapse_sql():
    return with_comments("""
WITH g AS (SELECT comment_text, min(id) AS id, count(*) AS n,
                  sum(CASE WHEN target IS NOT NULL THEN toxicity_annotator_count END) AS sw,
                  sum(target * CASE WHEN target IS NOT NULL THEN toxicity_annotator_count END) AS slw
           FROM comments GROUP BY comment_text)
SELECT c.id, round(CASE WHEN g.n > 1 THEN (CASE WHEN g.sw <> 0 THEN g.slw / g.sw END) ELSE c.target END, 9) AS target,
       c.toxicity_annotator_count, c.lang
FROM g JOIN comments c ON c.id = g.id""")


def removed_before(spark, sf_dir):
    return D.removed_before(comments(spark, sf_dir))


def removed_before_sql():
    return with_comments("""
WITH f AS (SELECT id, CASE WHEN id <> min(id) OVER (PARTITION BY comment_text) THEN 1 ELSE 0 END AS removed FROM comments),
r AS (SELECT id, removed, coalesce(sum(removed) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM f)
SELECT id, CAST(nb AS BIGINT) AS n_removed_before FROM r WHERE removed = 0""")


def _some_null(spark, sf_dir):
    return comments(spark, sf_dir).withColumn("comment_text", F.when(F.col("id") % 7 != 0, F.col("comment_text")))


NULL_TEXTS = "c AS (SELECT * REPLACE (CASE WHEN id % 7 <> 0 THEN comment_text END AS comment_text) FROM comments)"
SAME_TEXT = "PARTITION BY comment_text, CASE WHEN comment_text IS NULL THEN id END"


def null_text_duplicates(spark, sf_dir):
    return D.find_duplicates(_some_null(spark, sf_dir)).select("id")


def null_text_duplicates_sql():
    return with_comments(f"WITH {NULL_TEXTS} SELECT id FROM c QUALIFY count(*) OVER ({SAME_TEXT}) > 1")


def null_text_collapse(spark, sf_dir):
    return D.collapse_duplicates(_some_null(spark, sf_dir)).select("id")


def null_text_collapse_sql():
    return with_comments(f"WITH {NULL_TEXTS} SELECT id FROM c QUALIFY id = min(id) OVER ({SAME_TEXT})")


def null_text_removed(spark, sf_dir):
    return D.removed_before(_some_null(spark, sf_dir))


def null_text_removed_sql():
    return with_comments(f"""WITH {NULL_TEXTS},
f AS (SELECT id, CASE WHEN id <> min(id) OVER ({SAME_TEXT}) THEN 1 ELSE 0 END AS removed FROM c),
r AS (SELECT id, removed, coalesce(sum(removed) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM f)
SELECT id, CAST(nb AS BIGINT) AS n_removed_before FROM r WHERE removed = 0""")


def tagged(spark, sf_dir):
    return P.tagged_rows(comments(spark, sf_dir))


def tagged_sql():
    rows = " UNION ALL ".join(f"SELECT {_proj_sql()}, '{t}' AS tag FROM comments WHERE {t} = 1" for t in IDENTITY_COLUMNS)
    return with_comments(rows)


def untagged(spark, sf_dir):
    return P.untagged_rows(comments(spark, sf_dir))


def untagged_sql():
    cond = " OR ".join(f"coalesce({t} = 1, false)" for t in IDENTITY_COLUMNS)
    return with_comments(f"SELECT {_proj_sql()} FROM comments WHERE NOT ({cond})")


def projection(spark, sf_dir):
    return P.toxicity_projection(comments(spark, sf_dir))


def projection_sql():
    return with_comments(f"SELECT {_proj_sql()} FROM comments")


def bpsn_examples(spark, sf_dir):
    df = comments(spark, sf_dir).where(F.col("target").isNotNull())
    s, y = at_least("male", 0.5), at_least("target", 0.5)
    return P.union_filters(df, s & ~y, ~s & y).select("id", "target", "male", "score")


def bpsn_examples_sql():
    s, y = "coalesce(male >= 0.5e0, false)", "coalesce(target >= 0.5e0, false)"
    return with_comments(f"SELECT id, target, male, score FROM comments WHERE target IS NOT NULL AND "
                         f"(({s} AND NOT {y}) OR (NOT {s} AND {y}))")


def attach_predictions(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "toxic")
    preds = comments(spark, sf_dir).select("id", F.col("score").alias("prediction"))
    return P.attach_predictions(labels, preds)


def attach_predictions_sql():
    return with_comments("SELECT l.doc_id AS id, l.toxic, c.score AS prediction FROM labels l JOIN comments c ON c.id = l.doc_id")


# ------------------------------------------------------------------ H queries
def shuffled(spark, sf_dir):
    return H.shuffle(comments(spark, sf_dir).select("id"), position="position")


def shuffled_sql():
    return with_comments(f"SELECT id, row_number() OVER (ORDER BY {H.row_hash_sql('shuffle')}, id) - 1 AS position FROM comments")


def sample_n(spark, sf_dir):
    return H.sample_n(comments(spark, sf_dir).select("id", "lang"), 100)


def sample_n_sql():
    return with_comments(f"SELECT id, lang FROM comments ORDER BY {H.row_hash_sql('sample')}, id LIMIT 100")


def sample_then_split(spark, sf_dir):
    """H2 then H3: half of a sample's rows is held out, whatever the sample."""
    sample = H.sample_n(comments(spark, sf_dir).select("id"), 200)
    return sample.select("id", H.split_flag(0.5).alias("is_test"))


def sample_then_split_sql():
    return with_comments(f"SELECT id, {H.row_hash_sql('split')} < {int(0.5 * H.TWO_32)} AS is_test FROM "
                         f"(SELECT id FROM comments ORDER BY {H.row_hash_sql('sample')}, id LIMIT 200)")


def split(spark, sf_dir):
    return comments(spark, sf_dir).select("id", H.split_flag(0.3).alias("is_test"))


def split_sql():
    return with_comments(f"SELECT id, {H.row_hash_sql('split')} < {int(0.3 * H.TWO_32)} AS is_test FROM comments")


def balanced(spark, sf_dir):
    return H.balanced_sample(comments(spark, sf_dir).select("id", "target"), 200)


def balanced_sql():
    return with_comments(f"""
(SELECT id, target FROM comments WHERE target > 0.5e0 ORDER BY {H.row_hash_sql('balanced')}, id LIMIT 100)
UNION ALL
(SELECT id, target FROM comments WHERE target < 0.5e0 ORDER BY {H.row_hash_sql('balanced')}, id LIMIT 100)""")


def holdout(spark, sf_dir):
    return H.holdout_last(comments(spark, sf_dir).select("id"), 0.3)


def holdout_sql():
    return with_comments("SELECT id, row_number() OVER (ORDER BY id) - 1 >= floor(count(*) OVER () * 0.7e0) "
                         "AS is_validation FROM comments")


def folds(spark, sf_dir):
    return comments(spark, sf_dir).select("id", H.fold_column(3).alias("fold"))


def folds_sql():
    return with_comments(f"SELECT id, CAST({H.row_hash_sql('folds')} % 3 AS INTEGER) AS fold FROM comments")


def sample_like(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    unlabelled = docs.join(labelled, "id", "left_anti")
    return H.sample_like(unlabelled, labelled)


def sample_like_sql():
    h = H.row_hash_sql("like", "d.doc_id")
    return (f"SELECT id, lang FROM (SELECT d.doc_id AS id, d.lang, row_number() OVER (ORDER BY {h}, d.doc_id) - 1 AS pos "
            "FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)) "
            "WHERE pos < (SELECT count(*) FROM labels)")


def split_tables(spark, sf_dir):
    """The held-out split rebuilt as (text, label, identities)."""
    from biasframe.operators.normalize import to_bool
    from biasframe.schema import SCORED_IDENTITIES
    df = to_bool(comments(spark, sf_dir).where(F.col("target").isNotNull()))
    train, test = H.train_test_split(df, 0.2)
    return test.select("id", "comment_text", "target", *SCORED_IDENTITIES)


def split_tables_sql():
    from biasframe.schema import SCORED_IDENTITIES
    cols = ", ".join(f"coalesce({c} >= 0.5e0, false) AS {c}" for c in SCORED_IDENTITIES)
    return with_comments(f"SELECT id, comment_text, coalesce(target >= 0.5e0, false) AS target, {cols} "
                         f"FROM comments WHERE target IS NOT NULL AND {H.row_hash_sql('split')} < {int(0.2 * H.TWO_32)}")


QUERIES = {
    "b15_split_tables": (split_tables, split_tables_sql),
    "j1_find_duplicates": (find_duplicates, find_duplicates_sql),
    "j2_collapse_duplicates": (collapse, collapse_sql),
    "j3_removed_before": (removed_before, removed_before_sql),
    "j1_null_texts": (null_text_duplicates, null_text_duplicates_sql),
    "j2_null_texts": (null_text_collapse, null_text_collapse_sql),
    "j3_null_texts": (null_text_removed, null_text_removed_sql),
    "j4_j5_tagged_rows": (tagged, tagged_sql),
    "j6_untagged_rows": (untagged, untagged_sql),
    "j7_toxicity_projection": (projection, projection_sql),
    "j8_union_filters": (bpsn_examples, bpsn_examples_sql),
    "j10_attach_predictions": (attach_predictions, attach_predictions_sql),
    "h1_shuffle": (shuffled, shuffled_sql),
    "h2_sample_n": (sample_n, sample_n_sql),
    "h2_h3_sample_then_split": (sample_then_split, sample_then_split_sql),
    "h3_split": (split, split_sql),
    "h4_balanced_sample": (balanced, balanced_sql),
    "h5_holdout_last": (holdout, holdout_sql),
    "h6_folds": (folds, folds_sql),
    "h7_sample_like": (sample_like, sample_like_sql),
}
