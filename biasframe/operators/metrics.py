"""Bias and quality metrics (flagship).

Exact ROC AUC with ties, from per-score class counts:

    AUC = sum_x pos(x) * (neg_below(x) + neg(x)/2) / (P * N)

It is kept in integers as ``num2 = sum pos * (2*neg_below + neg)`` and
divided once, so the value does not depend on summation order. One class only
gives NULL (sklearn raises; the reference maps that to NaN).

The bias table needs, per subgroup ``S``, the subgroup AUC, the BPSN AUC
(background positives vs subgroup negatives) and the BNSP AUC (subgroup
positives vs background negatives). The background is "all rows minus the
subgroup", so each row is exploded only into the subgroups it belongs to plus
one ``__all__`` group; background counts are differences of the two. Per
(group, score) histograms are aggregated partial/final (a hot score is combined
map-side), the running counts come from ``running_sums_below`` (range
partitioned, no single-task window), and the per-subgroup rows meet the global
counts by an equi-join on the score.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biasframe.operators.ordering import attach_row, running_sums_below
from biasframe.schema import (BNSP_AUC, BPSN_AUC, OVERALL_MODEL_WEIGHT, POWER,
                              SUBGROUP_AUC)

ALL = "__all__"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _ratio(num: Column, den: Column) -> Column:
    """num / den as doubles, NULL when den is 0 (ANSI division would raise)."""
    return F.when(den != 0, num.cast("double") / den.cast("double"))


# Pair counts reach (rows)^2: at 10^12 rows that is past a long, so products
# are exact 38-digit decimals, and the P*N denominators are doubles.
_EXACT = "decimal(38,0)"


def _x(c: Column | str) -> Column:
    return _c(c).cast(_EXACT)


def _pairs(p: Column, n: Column) -> Column:
    return F.lit(2.0) * p.cast("double") * n.cast("double")


def score_histogram(df: DataFrame, score: Column | str, label: Column | str,
                    by: Sequence[str] = ()) -> DataFrame:
    """(by..., x, pos, neg): class counts per distinct score. Rows without a
    score are ignored; a NULL label counts as negative (``coalesce(false)``)."""
    y = F.coalesce(_c(label).cast("boolean"), F.lit(False))
    base = df.select(*by, _c(score).cast("double").alias("x"), y.alias("_y")).where(F.col("x").isNotNull())
    return base.groupBy(*by, "x").agg(F.count_if(F.col("_y")).alias("pos"),
                                      F.count_if(~F.col("_y")).alias("neg"))


def auc(df: DataFrame, score: Column | str, label: Column | str, by: Sequence[str] = (),
        name: str = "auc", parts: int | None = None) -> DataFrame:
    """Exact ROC AUC per group of ``by`` (one row when empty)."""
    by = list(by)
    hist = score_histogram(df, score, label, by)
    if not by:
        hist = hist.withColumn("_g", F.lit(1))
    keys = by or ["_g"]
    cum = running_sums_below(hist, keys, "x", ["neg"], parts)
    agg = cum.groupBy(*keys).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"),
                                 F.sum(_x("pos") * (2 * F.col("neg_below") + F.col("neg"))).alias("_num2"))
    out = agg.select(*by, _ratio(F.col("_num2"), _pairs(F.col("_p"), F.col("_n"))).alias(name))
    return out


def _bias_parts(df: DataFrame, subgroups: Mapping[str, Column | str], label: Column | str,
                score: Column | str, parts: int | None):
    member = F.array(F.lit(ALL), *[F.when(F.coalesce(_c(c).cast("boolean"), F.lit(False)), F.lit(n))
                                   for n, c in subgroups.items()])
    y = F.coalesce(_c(label).cast("boolean"), F.lit(False))
    rows = (df.select(_c(score).cast("double").alias("x"), y.alias("_y"), member.alias("_m"))
              .where(F.col("x").isNotNull())
              .select("x", "_y", F.explode(F.array_compact("_m")).alias("g")))
    hist = rows.groupBy("g", "x").agg(F.count_if(F.col("_y")).alias("pos"),
                                      F.count_if(~F.col("_y")).alias("neg"))
    cum = running_sums_below(hist, ["g"], "x", ["pos", "neg"], parts)
    glob = cum.where(F.col("g") == ALL).select(
        "x", F.col("pos").alias("pa"), F.col("neg").alias("na"),
        F.col("pos_below").alias("pab"), F.col("neg_below").alias("nab"))
    sub = cum.where(F.col("g") != ALL)
    return glob, sub


def bias_report(df: DataFrame, subgroups: Mapping[str, Column | str], label: Column | str,
                score: Column | str, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """K2-K6 from one histogram: (bias table, one-row ``overall_auc``).

    The bias table has one row per subgroup with ``subgroup_size`` and the
    three AUCs; ``subgroups`` maps a name to a boolean column (NULL = false)."""
    names = list(subgroups)
    glob, sub = _bias_parts(df, subgroups, label, score, parts)
    j = sub.join(glob, "x")
    pos, neg = F.col("pos"), F.col("neg")
    per_group = j.groupBy("g").agg(
        F.sum(pos).alias("ps"), F.sum(neg).alias("ns"),
        F.sum(_x(pos) * (2 * F.col("neg_below") + neg)).alias("s_sub"),
        # subgroup negatives x background positives at or above their score
        F.sum(_x(neg) * (2 * (F.col("pab") - F.col("pos_below")) + (F.col("pa") - pos))).alias("s_bpsn_low"),
        # subgroup positives x background negatives below / tied
        F.sum(_x(pos) * (2 * (F.col("nab") - F.col("neg_below")) + (F.col("na") - neg))).alias("s_bnsp"))
    totals = glob.agg(F.sum("pa").alias("pa_tot"), F.sum("na").alias("na_tot"),
                      F.sum(_x("pa") * (2 * F.col("nab") + F.col("na"))).alias("s_all"))
    spark = df.sparkSession
    # one row per requested subgroup (a bounded list), so empty subgroups stay
    wanted = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "g string, _ord int")
    t = wanted.join(F.broadcast(per_group), "g", "left").na.fill(0, ["ps", "ns", "s_sub", "s_bpsn_low", "s_bnsp"])
    t = attach_row(t, totals)
    ps, ns, pa, na = F.col("ps"), F.col("ns"), F.col("pa_tot"), F.col("na_tot")
    bpsn_num2 = 2 * _x(pa - ps) * ns - F.col("s_bpsn_low")
    table = t.select(
        F.col("g").alias("subgroup"), (ps + ns).alias("subgroup_size"),
        _ratio(F.col("s_sub"), _pairs(ps, ns)).alias(SUBGROUP_AUC),
        _ratio(bpsn_num2, _pairs(pa - ps, ns)).alias(BPSN_AUC),
        _ratio(F.col("s_bnsp"), _pairs(ps, na - ns)).alias(BNSP_AUC))
    overall = totals.select(_ratio(F.col("s_all"), _pairs(F.col("pa_tot"), F.col("na_tot"))).alias("overall_auc"))
    return table, overall


def bias_metrics(df: DataFrame, subgroups: Mapping[str, Column | str], label: Column | str,
                 score: Column | str, parts: int | None = None) -> DataFrame:
    """K2-K5: the bias table of ``bias_report``."""
    return bias_report(df, subgroups, label, score, parts)[0]


def power_mean(col: str, p: float = POWER) -> Column:
    """K7 as an aggregate: NULL when any value is NULL (numpy spreads NaN)."""
    return F.when(F.count(F.lit(1)) == F.count(F.col(col)),
                  F.pow(F.avg(F.pow(F.col(col), F.lit(float(p)))), F.lit(1.0 / p)))


def final_metric(bias_df: DataFrame, overall: DataFrame, power: float = POWER,
                 overall_weight: float = OVERALL_MODEL_WEIGHT, digits: int | None = 9) -> DataFrame:
    """K8: ``w * overall_auc + (1 - w) * mean(power means of the 3 AUCs)``.

    ``overall`` is a one-row DataFrame with column ``overall_auc``."""
    pm = bias_df.agg(power_mean(SUBGROUP_AUC, power).alias("pm_subgroup_auc"),
                     power_mean(BPSN_AUC, power).alias("pm_bpsn_auc"),
                     power_mean(BNSP_AUC, power).alias("pm_bnsp_auc"))
    t = attach_row(pm, overall.select("overall_auc"))
    bias_score = (F.col("pm_subgroup_auc") + F.col("pm_bpsn_auc") + F.col("pm_bnsp_auc")) / 3.0
    final = overall_weight * F.col("overall_auc") + (1 - overall_weight) * bias_score
    cols = ["overall_auc", "pm_subgroup_auc", "pm_bpsn_auc", "pm_bnsp_auc"]
    r = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return t.select(*[r(F.col(c)).alias(c) for c in cols], r(final).alias("final_metric"))


def training_report(df: DataFrame, subgroups: Mapping[str, Column | str], label: Column | str, score: Column | str,
                    threshold: float = 0.5, digits: int = 9) -> tuple[DataFrame, DataFrame]:
    """(bias table, one row with overall AUC, power means, final metric,
    accuracy, loss and weighted F1) of scored rows; class 1 is a score of at least
    ``threshold``."""
    bias, overall = bias_report(df, subgroups, label, score)
    p = F.coalesce(_c(score) >= threshold, F.lit(False)).cast("int").alias("_p")
    y = F.coalesce(_c(label).cast("boolean"), F.lit(False)).cast("int").alias("_y")
    rows = df.select(p, y, _c(score).alias("_s"))
    basic = accuracy(rows, "_p", "_y").select(F.round("accuracy", digits).alias("accuracy"))
    loss = rows.agg(F.round(F.avg(bce("_y", "_s")), digits).alias("loss"))
    f1 = f1_weighted(rows, "_p", "_y").select(F.round("f1_weighted", digits).alias("f1_weighted"))
    return bias, attach_row(attach_row(attach_row(final_metric(bias, overall, digits=digits), basic), loss), f1)


def overall_auc(df: DataFrame, score: Column | str, label: Column | str,
                parts: int | None = None) -> DataFrame:
    """K6: one row ``overall_auc``."""
    return auc(df, score, label, name="overall_auc", parts=parts)


# ------------------------------------------------------------ quality metrics
def accuracy(df: DataFrame, pred: Column | str, label: Column | str, name: str = "accuracy") -> DataFrame:
    """Share of rows whose prediction equals the label; for array
    columns (label matrices) the whole array must match. A missing prediction
    of a labelled row is wrong; rows without a label do not count."""
    right = F.when(_c(label).isNotNull(), F.coalesce(_c(pred) == _c(label), F.lit(False)))
    return df.agg(F.avg(right.cast("double")).alias(name))


def confusion(df: DataFrame, pred: Column | str, label: Column | str) -> DataFrame:
    """TP, TN, FP, FN of boolean prediction / label (NULL as false)."""
    p = F.coalesce(_c(pred).cast("boolean"), F.lit(False))
    y = F.coalesce(_c(label).cast("boolean"), F.lit(False))
    return df.agg(F.count_if(p & y).alias("tp"), F.count_if(~p & ~y).alias("tn"),
                  F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 = 2TP / (2TP + FP + FN); 0 when undefined (sklearn's zero_division)."""
    den = 2 * tp + fp + fn
    return F.when(den != 0, 2 * tp / den).otherwise(F.lit(0.0))


def precision_recall_f1(df: DataFrame, pred: Column | str, label: Column | str) -> DataFrame:
    """Precision, recall and F1 of the positive class (0 when undefined)."""
    c = confusion(df, pred, label)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(F.when(tp + fp != 0, tp / (tp + fp)).otherwise(F.lit(0.0)).alias("precision"),
                    F.when(tp + fn != 0, tp / (tp + fn)).otherwise(F.lit(0.0)).alias("recall"),
                    _f1(tp, fp, fn).alias("f1"))


def f1_weighted(df: DataFrame, pred: Column | str, label: Column | str) -> DataFrame:
    """K11 (single label, any classes): per-class F1 weighted by the class
    support. Classes are grouped, one pass plus a tiny second aggregate."""
    y, p = _c(label), _c(pred)
    # each row counts once for its true class and once for its predicted class
    ev = df.select(F.explode(F.array(
        F.struct(y.cast("string").alias("cls"), F.lit(1).alias("is_true"), (y == p).cast("int").alias("hit")),
        F.struct(p.cast("string").alias("cls"), F.lit(0).alias("is_true"), (y == p).cast("int").alias("hit")))).alias("e"))
    per = ev.groupBy("e.cls").agg(
        F.sum("e.is_true").alias("support"),
        F.sum(F.when(F.col("e.is_true") == 1, F.col("e.hit"))).alias("tp"),
        F.sum(F.when(F.col("e.is_true") == 0, 1 - F.col("e.hit"))).alias("fp"))
    per = per.na.fill(0, ["tp", "fp"]).withColumn("fn", F.col("support") - F.col("tp"))
    f1 = _f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return per.agg((F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1_weighted"))


def f1_weighted_multilabel(df: DataFrame, preds: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """K11 (label matrix): binary F1 per label, weighted by each label's
    number of positives. One aggregation over all labels."""
    aggs = []
    for p, y in zip(preds, labels):
        pc, yc = F.col(p).cast("boolean"), F.col(y).cast("boolean")
        aggs += [F.count_if(pc & yc).alias(f"{y}|tp"), F.count_if(pc & ~yc).alias(f"{y}|fp"),
                 F.count_if(~pc & yc).alias(f"{y}|fn")]
    wide = df.agg(*aggs)
    num = sum(_f1(F.col(f"`{y}|tp`"), F.col(f"`{y}|fp`"), F.col(f"`{y}|fn`")) * (F.col(f"`{y}|tp`") + F.col(f"`{y}|fn`"))
              for y in labels)
    den = sum(F.col(f"`{y}|tp`") + F.col(f"`{y}|fn`") for y in labels)
    return wide.select(F.when(den != 0, num / den).otherwise(F.lit(0.0)).alias("f1_weighted"))


def training_weight(label: Column | str, identities: Sequence[str], threshold: float = 0.5,
                    background: str = "any") -> Column:
    """1/4 + 1/4 [subgroup] + 1/4 [BPSN] + 1/4 [BNSP] per row.

    ``background='any'`` is the reference's literal test ("some identity is
    below the threshold"); ``'none'`` uses "no identity at or above it"."""
    from biasframe.functions.labels import no_nan
    vals = [F.coalesce(no_nan(c), F.lit(0.0)) for c in identities]
    any_in = F.greatest(*[(v >= threshold).cast("int") for v in vals]) == 1
    any_out = F.greatest(*[(v < threshold).cast("int") for v in vals]) == 1
    y = F.coalesce(no_nan(label) >= threshold, F.lit(False))
    bg = any_out if background == "any" else ~any_in
    ind = lambda b: F.when(b, F.lit(0.25)).otherwise(F.lit(0.0))
    return F.lit(0.25) + ind(any_in) + ind(y & bg) + ind(~y & any_in)


def loss_weight(df: DataFrame, weight: str = "weight") -> DataFrame:
    """``1 / mean(weight)`` as a one-row DataFrame."""
    return df.agg((F.lit(1.0) / F.avg(weight)).alias("loss_weight"))


def bce(y: Column | str, p: Column | str, eps: float = 1e-7) -> Column:
    """Per-row binary cross-entropy with the prediction clipped to [eps, 1-eps]."""
    pc = F.least(F.greatest(_c(p).cast("double"), F.lit(eps)), F.lit(1.0 - eps))
    yc = _c(y).cast("double")
    return -(yc * F.log(pc) + (F.lit(1.0) - yc) * F.log(F.lit(1.0) - pc))


def losses(df: DataFrame, y: Column | str, p: Column | str, w: Column | str,
           aux: Sequence[tuple[str, str]] = (), digits: int = 9) -> DataFrame:
    """Mean BCE, weighted BCE (mean of w * bce) and the two-part loss
    ``mean(w*bce) * loss_weight + mean(mean_k bce(aux_k))`` (standard
    orientation: truth first, prediction second)."""
    lw = F.lit(1.0) / F.avg(_c(w))
    aux_term = (sum(bce(a, q) for a, q in aux) / len(aux)) if aux else F.lit(0.0)
    return df.agg(F.round(F.avg(bce(y, p)), digits).alias("bce"),
                  F.round(F.avg(_c(w) * bce(y, p)), digits).alias("weighted_bce"),
                  F.round(F.avg(_c(w) * bce(y, p)) * lw + F.avg(aux_term), digits).alias("two_part_loss"))
