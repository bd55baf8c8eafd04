"""Flagship: the bias report over the labelled comments (K1-K9).

comments -> labelled rows -> boolean label and subgroup flags (B5) ->
exact subgroup / BPSN / BNSP AUC per subgroup (K2-K5), overall AUC (K6),
power means and final score (K7, K8).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biasframe.functions.labels import at_least
from biasframe.operators import metrics as M
from biasframe.operators.ordering import ranked
from biasframe.schema import LABEL_THRESHOLD, SCORED_IDENTITIES
from biasframe.sources.comments import comments, with_comments

# --- fixed values: the language subgroups of the stand-in table -------------
LANGS = ["en", "fr", "de", "es"]
# --- end of fixed values ----------------------------------------------------


def subgroup_flags() -> dict[str, Column]:
    flags = {f"lang_{lang}": F.col("lang") == F.lit(lang) for lang in LANGS}
    flags.update({c: at_least(c, LABEL_THRESHOLD) for c in SCORED_IDENTITIES})
    return flags


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled comments (the validation rows with a model score)."""
    return comments(spark, sf_dir, with_time=False).where(F.col("target").isNotNull())


def bias_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = labelled(spark, sf_dir)
    table = M.bias_metrics(df, subgroup_flags(), at_least("target", LABEL_THRESHOLD), "score")
    # I16: ascending by subgroup AUC, missing last (a 13-row result)
    return table.orderBy(F.asc_nulls_last("subgroup_auc"), "subgroup")


def ranked_bias_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I16: the places of the subgroups by rising AUC, missing ones last."""
    return ranked(bias_table(spark, sf_dir), [F.asc_nulls_last("subgroup_auc"), F.col("subgroup")]).select("position", "subgroup", "subgroup_auc")


def overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.overall_auc(labelled(spark, sf_dir), "score", at_least("target", LABEL_THRESHOLD))


def final_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, overall_df = M.bias_report(labelled(spark, sf_dir), subgroup_flags(),
                                      at_least("target", LABEL_THRESHOLD), "score")
    return M.final_metric(table, overall_df)


def auc_by_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 grouped: AUC per article (many small groups)."""
    return M.auc(labelled(spark, sf_dir), "score", at_least("target", LABEL_THRESHOLD),
                 by=["article_id"], name="auc")


# ----------------------------------------------------------------- oracle SQL
def _flag_sql(with_langs: bool = True) -> list[tuple[str, str]]:
    out = [(f"lang_{lang}", f"(lang = '{lang}')") for lang in LANGS] if with_langs else []
    out += [(c, f"coalesce({c} >= 0.5e0, false)") for c in SCORED_IDENTITIES]
    return out


def _auc_sql(num2: str, p: str, n: str) -> str:
    return f"CASE WHEN {p} * {n} = 0 THEN NULL ELSE ({num2}) / (2.0e0 * {p} * {n}) END"


def bias_table_sql(with_langs: bool = True) -> str:
    flags = _flag_sql(with_langs)
    base = ("base AS (SELECT score AS x, coalesce(target >= 0.5e0, false) AS y, "
            + ", ".join(f"{e} AS f_{n}" for n, e in flags)
            + " FROM comments WHERE target IS NOT NULL)")
    slices = []
    for n, _ in flags:
        f = f"f_{n}"
        slices.append(f"SELECT '{n}' AS g, 'sub' AS m, x, y FROM base WHERE {f}")
        slices.append(f"SELECT '{n}', 'bpsn', x, y FROM base WHERE ({f} AND NOT y) OR (NOT {f} AND y)")
        slices.append(f"SELECT '{n}', 'bnsp', x, y FROM base WHERE ({f} AND y) OR (NOT {f} AND NOT y)")
    sizes = " UNION ALL ".join(f"SELECT '{n}' AS g, count(*) FILTER (WHERE f_{n}) AS subgroup_size FROM base"
                               for n, _ in flags)
    return with_comments(f"""
WITH {base},
sl AS ({' UNION ALL '.join(slices)}),
h AS (SELECT g, m, x, sum(CASE WHEN y THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN y THEN 0 ELSE 1 END) AS neg
      FROM sl GROUP BY g, m, x),
c AS (SELECT g, m, x, pos, neg,
             coalesce(sum(neg) OVER (PARTITION BY g, m ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
      FROM h),
a AS (SELECT g, m, {_auc_sql('sum(pos * (2 * nb + neg))', 'sum(pos)', 'sum(neg)')} AS v FROM c GROUP BY g, m),
s AS ({sizes})
SELECT s.g AS subgroup, s.subgroup_size,
       (SELECT v FROM a WHERE a.g = s.g AND a.m = 'sub') AS subgroup_auc,
       (SELECT v FROM a WHERE a.g = s.g AND a.m = 'bpsn') AS bpsn_auc,
       (SELECT v FROM a WHERE a.g = s.g AND a.m = 'bnsp') AS bnsp_auc
FROM s""")


def ranked_bias_table_sql() -> str:
    return f"SELECT row_number() OVER (ORDER BY round(subgroup_auc, 12) NULLS LAST, subgroup) AS position, subgroup, subgroup_auc FROM ({bias_table_sql()})"


def report_of_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report of a model's scores, here of the stored ones."""
    df = labelled(spark, sf_dir)
    return M.training_report(df, subgroup_flags(), at_least("target", LABEL_THRESHOLD), "score")[1]


def report_of_scores_sql() -> str:
    clipped = "least(greatest(score, 1e-7), 1 - 1e-7)"
    return f"""
WITH f AS ({final_score_sql()}),
r AS ({with_comments(f"SELECT score >= 0.5e0 AS p, target >= 0.5e0 AS y, CASE WHEN target >= 0.5e0 THEN -ln({clipped}) ELSE -ln(1 - {clipped}) END AS loss FROM comments WHERE target IS NOT NULL")}),
c AS (SELECT count(*) FILTER (WHERE p AND y) AS tp, count(*) FILTER (WHERE NOT p AND NOT y) AS tn, count(*) FILTER (WHERE p AND NOT y) AS fp,
             count(*) FILTER (WHERE NOT p AND y) AS fn, avg(loss) AS loss, avg((p = y)::INTEGER) AS accuracy FROM r)
SELECT f.*, round(accuracy, 9) AS accuracy, round(loss, 9) AS loss,
       round(((tp + fn) * (2.0e0 * tp / (2 * tp + fp + fn)) + (tn + fp) * (2.0e0 * tn / (2 * tn + fn + fp))) / (tp + tn + fp + fn), 9) AS f1_weighted FROM f, c"""


def overall_sql() -> str:
    return with_comments(f"""
WITH h AS (SELECT score AS x, count(*) FILTER (WHERE target >= 0.5e0) AS pos,
                  count(*) FILTER (WHERE NOT (target >= 0.5e0)) AS neg
           FROM comments WHERE target IS NOT NULL AND score IS NOT NULL GROUP BY score),
c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM h)
SELECT {_auc_sql('sum(pos * (2 * nb + neg))', 'sum(pos)', 'sum(neg)')} AS overall_auc FROM c""")


def final_score_sql(with_langs: bool = True) -> str:
    inner_bias = bias_table_sql(with_langs)
    inner_overall = overall_sql()

    def pm(c: str) -> str:
        return f"CASE WHEN count(*) = count({c}) THEN pow(avg(pow({c}, -5.0e0)), 1.0e0 / -5.0e0) END"
    return f"""
WITH b AS ({inner_bias}),
o AS ({inner_overall}),
p AS (SELECT {pm('subgroup_auc')} AS ps, {pm('bpsn_auc')} AS pb, {pm('bnsp_auc')} AS pn FROM b)
SELECT round(o.overall_auc, 9) AS overall_auc, round(p.ps, 9) AS pm_subgroup_auc,
       round(p.pb, 9) AS pm_bpsn_auc, round(p.pn, 9) AS pm_bnsp_auc,
       round(0.25e0 * o.overall_auc + 0.75e0 * ((p.ps + p.pb + p.pn) / 3.0e0), 9) AS final_metric
FROM p, o"""


def auc_by_article_sql() -> str:
    return with_comments(f"""
WITH h AS (SELECT article_id, score AS x, count(*) FILTER (WHERE target >= 0.5e0) AS pos,
                  count(*) FILTER (WHERE NOT (target >= 0.5e0)) AS neg
           FROM comments WHERE target IS NOT NULL GROUP BY article_id, score),
c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY article_id ORDER BY x
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM h)
SELECT article_id, {_auc_sql('sum(pos * (2 * nb + neg))', 'sum(pos)', 'sum(neg)')} AS auc
FROM c GROUP BY article_id""")


QUERIES = {
    "k5_bias_table": (bias_table, bias_table_sql),
    "i16_ranked_bias_table": (ranked_bias_table, ranked_bias_table_sql),
    "l7_report_of_scores": (report_of_scores, report_of_scores_sql),
    "k6_overall_auc": (overall, overall_sql),
    "k8_final_metric": (final_score, final_score_sql),
    "k1_auc_by_article": (auc_by_article, auc_by_article_sql),
}
