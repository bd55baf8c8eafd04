"""Queries for quality metrics, training weights and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from biasframe.functions.labels import as_class, at_least
from biasframe.operators import metrics as M
from biasframe.operators.ordering import attach_row
from biasframe.plans.bias_report import _auc_sql, labelled
from biasframe.schema import SCORED_IDENTITIES, SUBTYPE_COLUMNS
from biasframe.sources.comments import with_comments



def _y():
    return at_least("target", 0.5)


def _pred():
    return at_least("score", 0.5)


Y_SQL = "coalesce(target >= 0.5e0, false)"
PRED_SQL = "coalesce(score >= 0.5e0, false)"
LAB = "FROM comments WHERE target IS NOT NULL"


def accuracy(spark, sf_dir):
    return M.accuracy(labelled(spark, sf_dir), _pred(), _y()).select(F.round("accuracy", 9).alias("accuracy"))


def accuracy_sql():
    return with_comments(f"SELECT round(avg(CAST({PRED_SQL} = {Y_SQL} AS DOUBLE)), 9) AS accuracy {LAB}")


def confusion(spark, sf_dir):
    return M.confusion(labelled(spark, sf_dir), _pred(), _y())


def _conf_sql() -> str:
    return (f"count(*) FILTER (WHERE {PRED_SQL} AND {Y_SQL}) AS tp, count(*) FILTER (WHERE NOT {PRED_SQL} AND NOT {Y_SQL}) AS tn, "
            f"count(*) FILTER (WHERE {PRED_SQL} AND NOT {Y_SQL}) AS fp, count(*) FILTER (WHERE NOT {PRED_SQL} AND {Y_SQL}) AS fn")


def confusion_sql():
    return with_comments(f"SELECT {_conf_sql()} {LAB}")


def prf(spark, sf_dir):
    out = M.precision_recall_f1(labelled(spark, sf_dir), _pred(), _y())
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


def prf_sql():
    return with_comments(f"""WITH c AS (SELECT {_conf_sql()} {LAB})
SELECT round(CASE WHEN tp + fp <> 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision,
       round(CASE WHEN tp + fn <> 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall,
       round(CASE WHEN 2 * tp + fp + fn <> 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1 FROM c""")


def f1w(spark, sf_dir):
    df = labelled(spark, sf_dir).select(as_class("score").alias("p"), as_class("target").alias("y"))
    return M.f1_weighted(df, "p", "y").select(F.round("f1_weighted", 9).alias("f1_weighted"))


def f1w_sql():
    p = f"CAST({PRED_SQL} AS INTEGER)"
    y = f"CAST({Y_SQL} AS INTEGER)"
    return with_comments(f"""WITH r AS (SELECT {p} AS p, {y} AS y {LAB}),
k AS (SELECT DISTINCT y AS cls FROM r UNION SELECT DISTINCT p FROM r),
s AS (SELECT k.cls, (SELECT count(*) FROM r WHERE r.y = k.cls) AS support,
             (SELECT count(*) FROM r WHERE r.y = k.cls AND r.p = k.cls) AS tp,
             (SELECT count(*) FROM r WHERE r.p = k.cls AND r.y <> k.cls) AS fp FROM k)
SELECT round(sum(CASE WHEN 2 * tp + fp + (support - tp) <> 0 THEN 2 * tp / (2 * tp + fp + (support - tp)) ELSE 0 END * support)
             / sum(support), 9) AS f1_weighted FROM s""")


def auc_hard(spark, sf_dir):
    return M.auc(labelled(spark, sf_dir), _pred().cast("int"), _y(), name="auc_hard_labels")


def auc_hard_sql():
    return with_comments(f"""WITH h AS (SELECT CAST({PRED_SQL} AS INTEGER) AS x, count(*) FILTER (WHERE {Y_SQL}) AS pos,
  count(*) FILTER (WHERE NOT {Y_SQL}) AS neg {LAB} GROUP BY 1),
c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM h)
SELECT {_auc_sql('sum(pos * (2 * nb + neg))', 'sum(pos)', 'sum(neg)')} AS auc_hard_labels FROM c""")


def identity_report(spark, sf_dir):
    """K9: per-identity AUCs (the nine scored identities) + the final score."""
    df = labelled(spark, sf_dir)
    flags = {c: at_least(c, 0.5) for c in SCORED_IDENTITIES}
    bias, overall = M.bias_report(df, flags, _y(), "score")
    final = M.final_metric(bias, overall)
    return attach_row(bias, final.select("final_metric"))


def identity_report_sql():
    from biasframe.plans.bias_report import bias_table_sql, final_score_sql
    return (f"WITH b AS ({bias_table_sql(False)}), f AS ({final_score_sql(False)}) "
            "SELECT b.*, f.final_metric FROM b, f")


def _w_sql(background: str = "any") -> str:
    vals = [f"coalesce({c}, 0)" for c in SCORED_IDENTITIES]
    any_in = "(greatest(" + ", ".join(f"CAST({v} >= 0.5e0 AS INTEGER)" for v in vals) + ") = 1)"
    any_out = "(greatest(" + ", ".join(f"CAST({v} < 0.5e0 AS INTEGER)" for v in vals) + ") = 1)"
    bg = any_out if background == "any" else f"(NOT {any_in})"
    ind = lambda b: f"(CASE WHEN {b} THEN 0.25e0 ELSE 0.0e0 END)"
    return f"(0.25e0 + {ind(any_in)} + {ind(f'{Y_SQL} AND {bg}')} + {ind(f'NOT {Y_SQL} AND {any_in}')})"


def weights(spark, sf_dir):
    df = labelled(spark, sf_dir)
    return df.select("id", M.training_weight("target", SCORED_IDENTITIES).alias("weight"),
                     M.training_weight("target", SCORED_IDENTITIES, background="none").alias("weight_none"))


def weights_sql():
    return with_comments(f"SELECT id, {_w_sql()} AS weight, {_w_sql('none')} AS weight_none {LAB}")


def loss_weight(spark, sf_dir):
    df = labelled(spark, sf_dir).select(M.training_weight("target", SCORED_IDENTITIES).alias("weight"))
    return M.loss_weight(df).select(F.round("loss_weight", 9).alias("loss_weight"))


def loss_weight_sql():
    return with_comments(f"SELECT round(1.0e0 / avg({_w_sql()}), 9) AS loss_weight {LAB}")


AUX = [(c, "score") for c in SUBTYPE_COLUMNS]


def losses(spark, sf_dir):
    df = labelled(spark, sf_dir).withColumn("w", M.training_weight("target", SCORED_IDENTITIES))
    return M.losses(df, _y().cast("double"), "score", "w", AUX)


def _bce_sql(y: str, p: str) -> str:
    pc = f"least(greatest({p}, 1e-7), 1.0e0 - 1e-7)"
    return f"(-(({y}) * ln({pc}) + (1.0e0 - ({y})) * ln(1.0e0 - {pc})))"


def losses_sql():
    y = f"CAST({Y_SQL} AS DOUBLE)"
    aux = " + ".join(_bce_sql(a, p) for a, p in AUX)
    return with_comments(f"""WITH r AS (SELECT *, {_w_sql()} AS w {LAB})
SELECT round(avg({_bce_sql(y, 'score')}), 9) AS bce, round(avg(w * {_bce_sql(y, 'score')}), 9) AS weighted_bce,
       round(avg(w * {_bce_sql(y, 'score')}) * (1.0e0 / avg(w)) + avg(({aux}) / {len(AUX)}), 9) AS two_part_loss FROM r""")


def targets(spark, sf_dir):
    df = labelled(spark, sf_dir)
    return df.select("id", as_class("target").alias("label"),
                     M.training_weight("target", SCORED_IDENTITIES).alias("weight"),
                     "target", *SUBTYPE_COLUMNS)


def targets_sql():
    return with_comments(f"SELECT id, CAST({Y_SQL} AS INTEGER) AS label, {_w_sql()} AS weight, target, "
                         f"{', '.join(SUBTYPE_COLUMNS)} {LAB}")


ML_LABELS = ["target", *SUBTYPE_COLUMNS]


def f1_multilabel(spark, sf_dir):
    """K11 on a label matrix: each of the 6 labels (>= 0.5) predicted by the
    one score (>= 0.5), binary F1 per label weighted by its positives."""
    df = labelled(spark, sf_dir)
    df = df.select(*[at_least(c, 0.5).alias(f"y_{c}") for c in ML_LABELS],
                   *[at_least("score", 0.5).alias(f"p_{c}") for c in ML_LABELS])
    out = M.f1_weighted_multilabel(df, [f"p_{c}" for c in ML_LABELS], [f"y_{c}" for c in ML_LABELS])
    return out.select(F.round("f1_weighted", 9).alias("f1_weighted"))


def f1_multilabel_sql():
    parts = []
    for c in ML_LABELS:
        y = f"coalesce({c} >= 0.5e0, false)"
        parts.append(f"count(*) FILTER (WHERE {PRED_SQL} AND {y}) AS tp_{c}, "
                     f"count(*) FILTER (WHERE {PRED_SQL} AND NOT {y}) AS fp_{c}, "
                     f"count(*) FILTER (WHERE NOT {PRED_SQL} AND {y}) AS fn_{c}")
    num = " + ".join(f"(CASE WHEN 2 * tp_{c} + fp_{c} + fn_{c} <> 0 THEN 2 * tp_{c} / (2 * tp_{c} + fp_{c} + fn_{c}) ELSE 0 END) * (tp_{c} + fn_{c})"
                     for c in ML_LABELS)
    den = " + ".join(f"(tp_{c} + fn_{c})" for c in ML_LABELS)
    return with_comments(f"WITH c AS (SELECT {', '.join(parts)} {LAB}) "
                         f"SELECT round(CASE WHEN {den} <> 0 THEN ({num}) / ({den}) ELSE 0 END, 9) AS f1_weighted FROM c")


QUERIES = {
    "k11_f1_multilabel": (f1_multilabel, f1_multilabel_sql),
    "k10_accuracy": (accuracy, accuracy_sql),
    "k11_f1_weighted": (f1w, f1w_sql),
    "k12_precision_recall_f1": (prf, prf_sql),
    "k13_confusion": (confusion, confusion_sql),
    "k14_auc_hard_labels": (auc_hard, auc_hard_sql),
    "k9_identity_report": (identity_report, identity_report_sql),
    "k15_training_weights": (weights, weights_sql),
    "k16_loss_weight": (loss_weight, loss_weight_sql),
    "k17_losses": (losses, losses_sql),
    "k18_training_targets": (targets, targets_sql),
}
