"""Declared schema and fixed column groups of the annotated-comments table.

The reference infers its schema from a CSV header; here it is declared once.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values (must equal the reference for the same results) -----------
# The 24 identity columns, in the order the reference lists them.
IDENTITY_COLUMNS = [
    "asian", "atheist", "bisexual", "black", "buddhist", "christian", "female",
    "heterosexual", "hindu", "homosexual_gay_or_lesbian",
    "intellectual_or_learning_disability", "jewish", "latino", "male", "muslim",
    "other_disability", "other_gender", "other_race_or_ethnicity", "other_religion",
    "other_sexual_orientation", "physical_disability",
    "psychiatric_or_mental_illness", "transgender", "white",
]
# The nine identities scored by the bias metric, in the reference's order.
SCORED_IDENTITIES = [
    "male", "female", "homosexual_gay_or_lesbian", "christian", "jewish",
    "muslim", "black", "white", "psychiatric_or_mental_illness",
]
# Toxicity subtypes, in the reference's order.
SUBTYPE_COLUMNS = ["severe_toxicity", "obscene", "identity_attack", "insult", "threat"]
# Reaction counts, in the reference's order.
REACTION_COLUMNS = ["funny", "wow", "sad", "likes", "disagree"]
# Article information columns.
ARTICLE_INFO_COLUMNS = ["rating", "funny", "wow", "sad", "likes", "disagree", "sexual_explicit"]
# Thresholds of the rule table for boolean conversion.
LABEL_THRESHOLD = 0.5
TOXICITY_ANNOTATOR_THRESHOLD = 8.78
IDENTITY_ANNOTATOR_THRESHOLD = 1.44
APPROVED_RATING = "approved"
# Metric names and weights of the final bias score.
SUBGROUP_AUC = "subgroup_auc"
BPSN_AUC = "bpsn_auc"
BNSP_AUC = "bnsp_auc"
POWER = -5
OVERALL_MODEL_WEIGHT = 0.25
# --- end of fixed values -----------------------------------------------------

TEXT_COLUMN = "comment_text"
LABEL_COLUMN = "target"
ID_COLUMN = "id"

# The 10-column label matrix and the 19-column / 17-tag matrices.
LABEL_MATRIX_10 = ["target"] + SCORED_IDENTITIES
LABEL_MATRIX_19 = (["target"] + SCORED_IDENTITIES + SUBTYPE_COLUMNS
                   + ["rating", "toxicity_annotator_count", "identity_annotator_count", "article_id"])
TAG_MATRIX_17 = (SCORED_IDENTITIES + SUBTYPE_COLUMNS
                 + ["toxicity_annotator_count", "identity_annotator_count", "article_id"])
# The 8-column toxicity projection written per tag.
TOXICITY_PROJECTION = ["id", "comment_text", "target"] + SUBTYPE_COLUMNS


def comments_schema(article_id_type: T.DataType = T.LongType()) -> T.StructType:
    """Declared schema of the annotated CSV (train file)."""
    fields = [T.StructField("id", T.LongType()),
              T.StructField("target", T.DoubleType()),
              T.StructField("comment_text", T.StringType())]
    fields += [T.StructField(c, T.DoubleType()) for c in SUBTYPE_COLUMNS]
    fields += [T.StructField(c, T.DoubleType()) for c in IDENTITY_COLUMNS]
    fields += [T.StructField("created_date", T.StringType()),
               T.StructField("publication_id", T.LongType()),
               T.StructField("parent_id", T.LongType()),
               T.StructField("article_id", article_id_type),
               T.StructField("rating", T.StringType())]
    fields += [T.StructField(c, T.IntegerType()) for c in REACTION_COLUMNS]
    fields += [T.StructField("sexual_explicit", T.DoubleType()),
               T.StructField("identity_annotator_count", T.IntegerType()),
               T.StructField("toxicity_annotator_count", T.IntegerType())]
    return T.StructType(fields)


TEST_SCHEMA = T.StructType([T.StructField("id", T.LongType()),
                            T.StructField("comment_text", T.StringType())])
SUBMISSION_SCHEMA = T.StructType([T.StructField("id", T.LongType()),
                                  T.StructField("prediction", T.DoubleType())])
