"""Queries for label conversion, filters and exploratory aggregation (B, C, I)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biasframe.functions import labels as L
from biasframe.functions import sqltext as S
from biasframe.functions import text as X
from biasframe.operators import explore as E
from biasframe.operators import normalize as N
from biasframe.operators.features import identity_tag_count
from biasframe.operators.ordering import ranked
from biasframe.schema import (IDENTITY_COLUMNS, LABEL_MATRIX_10, REACTION_COLUMNS, SCORED_IDENTITIES,
                              SUBTYPE_COLUMNS)
from biasframe.sources.comments import comments, with_comments
from biasframe.sources.tables import table

NUMERIC = (["target", *IDENTITY_COLUMNS, *SUBTYPE_COLUMNS, *REACTION_COLUMNS, "sexual_explicit",
            "toxicity_annotator_count", "identity_annotator_count", "score"])
LINEITEM_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
RULE_COLUMNS = ["target", *SCORED_IDENTITIES, *SUBTYPE_COLUMNS, "rating",
                "toxicity_annotator_count", "identity_annotator_count", "article_id"]


def filled(spark: SparkSession, sf_dir: str, with_time: bool = False) -> DataFrame:
    """The notebook's ``fillna(0.0)`` on numeric columns."""
    return N.fill_numeric(comments(spark, sf_dir, with_time), 0.0)


def _ge(c: str, t: str = "0.5e0") -> str:
    return f"coalesce({c} >= {t}, false)"


def _filled_sql() -> str:
    cols = ", ".join(f"coalesce({c}, 0) AS {c}" for c in NUMERIC)
    return f"filled AS (SELECT * REPLACE ({cols}) FROM comments)"


# ------------------------------------------------------------------ B queries
def rename_keep(spark, sf_dir):
    df = N.rename_columns(comments(spark, sf_dir), {"comment_text": "Reviews", "target": "Label", "absent": "x"})
    return N.keep_columns(df, ["id", "Reviews", "Label", "lang", "not_there"])


def rename_keep_sql():
    return with_comments("SELECT id, comment_text AS Reviews, target AS Label, lang FROM comments")


def fill_numeric(spark, sf_dir):
    return filled(spark, sf_dir).select("id", "target", *IDENTITY_COLUMNS, "comment_text")


def fill_numeric_sql():
    return with_comments(f"WITH {_filled_sql()} SELECT id, target, {', '.join(IDENTITY_COLUMNS)}, comment_text FROM filled")


def to_bool(spark, sf_dir):
    return N.to_bool(comments(spark, sf_dir)).select("id", "target", *SCORED_IDENTITIES)


def to_bool_sql():
    return with_comments("SELECT id, " + ", ".join(f"{_ge(c)} AS {c}" for c in ["target", *SCORED_IDENTITIES])
                         + " FROM comments")


def rule_table(spark, sf_dir):
    return N.apply_rule_table(comments(spark, sf_dir)).select("id", *RULE_COLUMNS)


def rule_table_sql():
    cols = [f"{_ge(c)} AS {c}" for c in ["target", *SCORED_IDENTITIES, *SUBTYPE_COLUMNS]]
    cols += ["coalesce(rating = 'approved', false) AS rating",
             f"{_ge('toxicity_annotator_count', '8.78e0')} AS toxicity_annotator_count",
             f"{_ge('identity_annotator_count', '1.44e0')} AS identity_annotator_count", "article_id"]
    return with_comments("SELECT id, " + ", ".join(cols) + " FROM comments")


def equal_one(spark, sf_dir):
    return N.identities_equal_one(comments(spark, sf_dir)).select("id", *IDENTITY_COLUMNS)


def equal_one_sql():
    return with_comments("SELECT id, " + ", ".join(f"coalesce({c} = 1.0e0, false) AS {c}" for c in IDENTITY_COLUMNS)
                         + " FROM comments")


def classes(spark, sf_dir):
    return comments(spark, sf_dir).select("id", L.as_class("target").alias("label_class"),
                                          L.as_class("score").alias("pred_class"),
                                          L.nonzero("score").alias("pred_nonzero"))


def classes_sql():
    return with_comments("SELECT id, CAST(coalesce(target >= 0.5e0, false) AS INTEGER) AS label_class, "
                         "CAST(coalesce(score >= 0.5e0, false) AS INTEGER) AS pred_class, "
                         "coalesce(score <> 0, false) AS pred_nonzero FROM comments")


def label_matrix(spark, sf_dir):
    df = N.to_bool(comments(spark, sf_dir), LABEL_MATRIX_10)
    return df.select("id", N.label_matrix(LABEL_MATRIX_10).alias("labels"))


def label_matrix_sql():
    return with_comments("SELECT id, [" + ", ".join(_ge(c) for c in LABEL_MATRIX_10) + "] AS labels FROM comments")


def label_tag_matrix(spark, sf_dir):
    """18 boolean labels + article, 16 boolean tags + article."""
    df = N.apply_rule_table(comments(spark, sf_dir))
    lab = [c for c in RULE_COLUMNS if c != "article_id"]
    tags = [c for c in lab if c not in ("target", "rating")]
    return df.select("id", N.label_matrix(lab).alias("labels"), N.label_matrix(tags).alias("tags"), "article_id")


def label_tag_matrix_sql():
    rule = {c: _ge(c) for c in ["target", *SCORED_IDENTITIES, *SUBTYPE_COLUMNS]}
    rule["rating"] = "coalesce(rating = 'approved', false)"
    rule["toxicity_annotator_count"] = _ge("toxicity_annotator_count", "8.78e0")
    rule["identity_annotator_count"] = _ge("identity_annotator_count", "1.44e0")
    lab = [c for c in RULE_COLUMNS if c != "article_id"]
    tags = [c for c in lab if c not in ("target", "rating")]
    return with_comments("SELECT id, [" + ", ".join(rule[c] for c in lab) + "] AS labels, ["
                         + ", ".join(rule[c] for c in tags) + "] AS tags, article_id FROM comments")


def softmax(spark, sf_dir):
    df = comments(spark, sf_dir).where(F.col("score").isNotNull())
    return df.select("id", F.round(L.softmax_positive(1.0 - F.col("score"), F.col("score")), 9).alias("p_toxic"))


def softmax_sql():
    return with_comments("SELECT id, round(1.0e0 / (1.0e0 + exp((1.0e0 - score) - score)), 9) AS p_toxic "
                         "FROM comments WHERE score IS NOT NULL")


def hour(spark, sf_dir):
    return comments(spark, sf_dir, with_time=True).select("id", L.hour_decimal("created_date").alias("hour"))


def hour_sql():
    return with_comments("SELECT id, hour(created_date) + minute(created_date) / 60.0e0 AS hour FROM comments")


def one_hot(spark, sf_dir):
    return comments(spark, sf_dir).select("id", L.one_hot(L.as_class("target")).alias("one_hot"))


def one_hot_sql():
    c = "CAST(coalesce(target >= 0.5e0, false) AS INTEGER)"
    return with_comments(f"SELECT id, [CAST({c} = 0 AS DOUBLE), CAST({c} = 1 AS DOUBLE)] AS one_hot FROM comments")


def label_index(spark, sf_dir):
    return N.label_index(comments(spark, sf_dir).select("id", "rating"), "rating", "rating_index")


def label_index_sql():
    return with_comments("SELECT id, rating, dense_rank() OVER (ORDER BY rating) - 1 AS rating_index FROM comments")


# ------------------------------------------------------------------ C queries
def long_comments(spark, sf_dir):
    c = comments(spark, sf_dir)
    n = X.space_split_count("comment_text")
    return c.where(n > 200).select("id", n.cast("long").alias("n_pieces"))


def long_comments_sql():
    n = S.space_split_count("comment_text")
    return with_comments(f"SELECT id, CAST({n} AS BIGINT) AS n_pieces FROM comments WHERE {n} > 200")


def articles_mean_one(spark, sf_dir):
    g = filled(spark, sf_dir).groupBy("article_id").agg(F.avg("target").alias("mean_target"))
    return g.where(F.col("mean_target") == 1.0)


def articles_mean_one_sql():
    return with_comments(f"WITH {_filled_sql()} SELECT article_id, avg(target) AS mean_target FROM filled "
                         "GROUP BY article_id HAVING avg(target) = 1")


def tag_count_filters(spark, sf_dir):
    n = identity_tag_count()
    return filled(spark, sf_dir).agg(F.count_if(n > 0).alias("n_gt_0"), F.count_if(n > 15).alias("n_gt_15"),
                                     F.count_if(n > -1).alias("n_gt_minus_1"))


def tag_count_filters_sql():
    n = " + ".join(f"CASE WHEN {c} <> 0 THEN 1 ELSE 0 END" for c in IDENTITY_COLUMNS)
    return with_comments(f"WITH {_filled_sql()}, t AS (SELECT {n} AS n FROM filled) SELECT count(*) FILTER (WHERE n > 0) AS n_gt_0, "
                         "count(*) FILTER (WHERE n > 15) AS n_gt_15, count(*) FILTER (WHERE n > -1) AS n_gt_minus_1 FROM t")


def subgroup_masks(spark, sf_dir):
    """Sizes of S, S&~L, ~S&L, S&L, ~S&~L per scored identity (labelled rows)."""
    df = N.to_bool(comments(spark, sf_dir).where(F.col("target").isNotNull()))
    y = F.col("target")
    aggs = []
    for c in SCORED_IDENTITIES:
        s = F.col(c)
        aggs += [F.count_if(s).alias(f"{c}|s"), F.count_if(s & ~y).alias(f"{c}|s_not_l"),
                 F.count_if(~s & y).alias(f"{c}|not_s_l"), F.count_if(s & y).alias(f"{c}|s_l"),
                 F.count_if(~s & ~y).alias(f"{c}|not_s_not_l")]
    wide = df.agg(*aggs)
    long = wide.unpivot([], wide.columns, "key", "n")
    parts = F.split("key", "\\|")
    return long.select(parts[0].alias("subgroup"), parts[1].alias("mask"), "n")


def subgroup_masks_sql():
    rows = []
    for c in SCORED_IDENTITIES:
        s = _ge(c)
        y = "coalesce(target >= 0.5e0, false)"
        for m, cond in [("s", s), ("s_not_l", f"{s} AND NOT {y}"), ("not_s_l", f"NOT {s} AND {y}"),
                        ("s_l", f"{s} AND {y}"), ("not_s_not_l", f"NOT {s} AND NOT {y}")]:
            rows.append(f"SELECT '{c}' AS subgroup, '{m}' AS mask, count(*) FILTER (WHERE {cond}) AS n "
                        "FROM comments WHERE target IS NOT NULL")
    return with_comments(" UNION ALL ".join(rows))


def head10(spark, sf_dir):
    return N.head(comments(spark, sf_dir).select("id", "lang", "target"), 10)


def head10_sql():
    return with_comments("SELECT id, lang, target FROM comments ORDER BY id LIMIT 10")


def row_at(spark, sf_dir):
    return N.row_at(comments(spark, sf_dir).select("id", "article_id", "target"), 100, ["id"])


def row_at_sql():
    return with_comments("SELECT id, article_id, target FROM comments ORDER BY id LIMIT 1 OFFSET 100")


def drop_missing(spark, sf_dir):
    """C8 over the labelled join: rows whose label-side text is present."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    j = lab.join(d.select("doc_id", "text"), "doc_id", "left")
    return N.drop_missing_text(j, "text").select("doc_id", "toxic")


def drop_missing_sql():
    return ("SELECT l.doc_id, l.toxic FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id "
            "WHERE d.text IS NOT NULL")


# ------------------------------------------------------------------ I queries
def _describe_sql(source: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        v = f"CAST({c} AS DOUBLE)"
        parts.append(f"SELECT '{c}' AS \"column\", count({v}) AS count, round(avg({v}), 9) AS mean, "
                     f"round(stddev_samp({v}), 9) AS std, min({v}) AS min, max({v}) AS max, "
                     f"round(quantile_cont({v}, 0.25), 9) AS q25, round(quantile_cont({v}, 0.5), 9) AS q50, "
                     f"round(quantile_cont({v}, 0.75), 9) AS q75 FROM {source}")
    return " UNION ALL ".join(parts)


def describe(spark, sf_dir):
    return E.describe(comments(spark, sf_dir), NUMERIC)


def describe_sql():
    return with_comments(_describe_sql("comments", NUMERIC))


def describe_lineitem(spark, sf_dir):
    return E.describe(table(spark, sf_dir, "lineitem"), LINEITEM_NUMERIC)


def describe_lineitem_sql():
    return _describe_sql("lineitem", LINEITEM_NUMERIC)


def article_means(spark, sf_dir):
    return E.group_means(filled(spark, sf_dir), "article_id", NUMERIC)


def article_means_sql():
    cols = ", ".join(f"round(avg({c}), 9) AS {c}" for c in NUMERIC)
    return with_comments(f"WITH {_filled_sql()} SELECT article_id, {cols} FROM filled GROUP BY article_id")


def identity_counts(spark, sf_dir):
    return E.identity_counts(filled(spark, sf_dir))


def identity_counts_sql():
    rows = " UNION ALL ".join(f"SELECT '{c}' AS identity, count(*) FILTER (WHERE {c} > 0) AS n_comments FROM filled"
                              for c in IDENTITY_COLUMNS)
    return with_comments(f"WITH {_filled_sql()} {rows}")


def identity_toxicity(spark, sf_dir):
    return E.identity_toxicity(filled(spark, sf_dir))


def ranked_identities(spark, sf_dir):
    """The places of the identities by falling size."""
    rows = E.identity_toxicity(filled(spark, sf_dir)).select("identity", "size")
    return ranked(rows, [F.desc("size"), F.col("identity")])


def ranked_identities_sql():
    return f"SELECT identity, size, row_number() OVER (ORDER BY size DESC, identity) AS position FROM ({identity_toxicity_sql()})"


def identity_toxicity_sql():
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS identity, avg(target) AS r, count(*) FILTER (WHERE target > 0.5e0) AS n_toxic, "
        f"count(*) FILTER (WHERE target < 0.5e0) AS n_non_toxic, count(*) AS size FROM filled WHERE {c} > 0"
        for c in IDENTITY_COLUMNS)
    return with_comments(f"WITH {_filled_sql()}, t AS ({rows}) SELECT identity, round(r, 9) AS ratio, n_toxic, "
                         "n_non_toxic, size, round(r * 100.0e0, 1) AS pct_round, "
                         "CAST(trunc(r * 1000.0e0) AS BIGINT) / 10.0e0 AS pct_floor FROM t WHERE size > 0")


def tag_distribution(spark, sf_dir):
    return (filled(spark, sf_dir).select(identity_tag_count().alias("n_tags"))
            .groupBy("n_tags").agg(F.count(F.lit(1)).alias("n_comments")))


def tag_distribution_sql():
    n = " + ".join(f"CASE WHEN {c} <> 0 THEN 1 ELSE 0 END" for c in IDENTITY_COLUMNS)
    return with_comments(f"WITH {_filled_sql()} SELECT {n} AS n_tags, count(*) AS n_comments FROM filled GROUP BY 1")


def cooccurrence(spark, sf_dir):
    return E.cooccurrence(filled(spark, sf_dir))


def cooccurrence_sql():
    rows = []
    for a in IDENTITY_COLUMNS:
        for b in IDENTITY_COLUMNS:
            if a != b:
                rows.append(f"SELECT '{a}' AS identity, '{b}' AS other, count(*) FILTER (WHERE {a} > 0 AND {b} > 0) AS n_both, "
                            f"count(*) FILTER (WHERE {b} > 0) AS n_b FROM filled")
    return with_comments(f"WITH {_filled_sql()}, t AS ({' UNION ALL '.join(rows)}) SELECT identity, other, n_both, n_b, "
                         "round(CASE WHEN n_b <> 0 THEN n_both / n_b END, 9) AS ratio FROM t")


def _hist_sql(values: str, k: int, by: list[str] | None = None) -> str:
    """values: a query with columns (by..., x)."""
    by = by or []
    bcols = "".join(f"{b}, " for b in by)
    grp = f"GROUP BY {', '.join(by)}" if by else ""
    join_r = " AND ".join(f"v.{b} = r.{b}" for b in by) or "true"
    join_c = "".join(f" AND c.{b} = r.{b}" for b in by)
    rsel = "".join(f"r.{b}, " for b in by)
    return f"""
WITH v AS (SELECT {bcols}CAST(x AS DOUBLE) AS x FROM ({values}) WHERE x IS NOT NULL AND NOT isnan(CAST(x AS DOUBLE))),
r AS (SELECT {bcols}min(x) AS lo, max(x) AS hi FROM v {grp}),
c AS (SELECT {''.join(f'v.{b}, ' for b in by)}CAST(CASE WHEN r.hi = r.lo THEN 0 ELSE least(floor((v.x - r.lo) * {k} / (r.hi - r.lo)), {k - 1}) END AS INTEGER) AS bin,
             count(*) AS cnt FROM v JOIN r ON {join_r} GROUP BY ALL)
SELECT {rsel}CAST(g.range AS INTEGER) AS bin, r.lo + CAST(g.range AS INTEGER) * (r.hi - r.lo) / {k} AS bin_lo,
       r.lo + (CAST(g.range AS INTEGER) + 1) * (r.hi - r.lo) / {k} AS bin_hi, coalesce(c.cnt, 0) AS count
FROM r CROSS JOIN range({k}) g LEFT JOIN c ON c.bin = CAST(g.range AS INTEGER){join_c}"""


def hist_target(spark, sf_dir):
    return E.histogram(filled(spark, sf_dir), "target", 15)


def hist_target_sql():
    return with_comments(f"WITH {_filled_sql()} " + _hist_sql("SELECT target AS x FROM filled", 15).lstrip().replace("WITH ", ", ", 1))


def hist_reactions(spark, sf_dir):
    cols = [*REACTION_COLUMNS, "sexual_explicit"]
    long = filled(spark, sf_dir).select(*[F.col(c).cast("double") for c in cols]).unpivot([], cols, "column", "x")
    return E.histogram(long, "x", 20, by=["column"])


def hist_reactions_sql():
    cols = [*REACTION_COLUMNS, "sexual_explicit"]
    vals = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS x FROM filled" for c in cols)
    return with_comments(f"WITH {_filled_sql()} " + _hist_sql(vals, 20, ['"column"']).lstrip().replace("WITH ", ", ", 1))


def hist_tag_count(spark, sf_dir):
    return E.histogram(filled(spark, sf_dir).select(identity_tag_count().alias("n")), "n", 22)


def hist_tag_count_sql():
    n = " + ".join(f"CASE WHEN {c} <> 0 THEN 1 ELSE 0 END" for c in IDENTITY_COLUMNS)
    return with_comments(f"WITH {_filled_sql()} " + _hist_sql(f"SELECT {n} AS x FROM filled", 22).lstrip().replace("WITH ", ", ", 1))


def hist_length(spark, sf_dir):
    n = X.space_split_count("comment_text")
    return E.histogram(comments(spark, sf_dir).where(n < 201).select(n.alias("n")), "n", 50)


def hist_length_sql():
    n = S.space_split_count("comment_text")
    return with_comments(_hist_sql(f"SELECT {n} AS x FROM comments WHERE {n} < 201", 50))


def hist_hour(spark, sf_dir):
    return E.histogram(comments(spark, sf_dir, with_time=True).select(L.hour_decimal("created_date").alias("h")), "h", 96)


def hist_hour_sql():
    return with_comments(_hist_sql("SELECT hour(created_date) + minute(created_date) / 60.0e0 AS x FROM comments", 96))


def hist_lineitem(spark, sf_dir):
    return E.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 50)


def hist_lineitem_sql():
    return _hist_sql("SELECT l_extendedprice AS x FROM lineitem", 50)


def hist_by_identity(spark, sf_dir):
    """I8: target histogram (50 bins) per identity, over rows with it > 0."""
    long = (filled(spark, sf_dir).select("target", *IDENTITY_COLUMNS)
            .unpivot(["target"], IDENTITY_COLUMNS, "identity", "v").where(F.col("v") > 0))
    return E.histogram(long, "target", 50, by=["identity"])


def hist_by_identity_sql():
    vals = " UNION ALL ".join(f"SELECT '{c}' AS identity, target AS x FROM filled WHERE {c} > 0" for c in IDENTITY_COLUMNS)
    return with_comments(f"WITH {_filled_sql()} " + _hist_sql(vals, 50, ["identity"]).lstrip().replace("WITH ", ", ", 1))


def hist_article_means(spark, sf_dir):
    means = filled(spark, sf_dir).groupBy("article_id").agg(F.avg("target").alias("m"))
    return E.histogram(means, "m", 50)


def hist_article_means_sql():
    return with_comments(f"WITH {_filled_sql()} " + _hist_sql(
        "SELECT avg(target) AS x FROM filled GROUP BY article_id", 50).lstrip().replace("WITH ", ", ", 1))


def corr_hour(spark, sf_dir):
    df = filled(spark, sf_dir, with_time=True).select(L.hour_decimal("created_date").alias("h"), "target")
    return df.agg(F.round(F.corr("h", "target"), 9).alias("corr"))


def corr_hour_sql():
    return with_comments(f"WITH {_filled_sql()} SELECT round(corr(hour(created_date) + minute(created_date) / 60.0e0, target), 9) AS corr FROM filled")


def night_mean(spark, sf_dir):
    h = L.hour_decimal("created_date")
    df = filled(spark, sf_dir, with_time=True).where((h > 20) & (h < 22))
    return df.agg(F.round(F.avg("target"), 9).alias("mean_target"), F.count(F.lit(1)).alias("n_comments"))


def night_mean_sql():
    h = "(hour(created_date) + minute(created_date) / 60.0e0)"
    return with_comments(f"WITH {_filled_sql()} SELECT round(avg(target), 9) AS mean_target, count(*) AS n_comments "
                         f"FROM filled WHERE {h} > 20 AND {h} < 22")


def label_frequency(spark, sf_dir):
    return filled(spark, sf_dir).groupBy("target").agg(F.count(F.lit(1)).alias("n_comments"))


def label_frequency_sql():
    return with_comments(f"WITH {_filled_sql()} SELECT target, count(*) AS n_comments FROM filled GROUP BY target")


def distinct_classes(spark, sf_dir):
    df = comments(spark, sf_dir).where(F.col("score").isNotNull())
    return df.select(L.as_class("score").alias("pred_class")).distinct().orderBy("pred_class")


def distinct_classes_sql():
    return with_comments("SELECT DISTINCT CAST(score >= 0.5e0 AS INTEGER) AS pred_class FROM comments "
                         "WHERE score IS NOT NULL")


def weighted_avg(spark, sf_dir):
    df = comments(spark, sf_dir).where(F.col("target").isNotNull())
    out = E.weighted_average(df, "target", "toxicity_annotator_count", by=["article_id"])
    return out.select("article_id", F.round("weighted_avg", 9).alias("weighted_avg"))


def weighted_avg_sql():
    return with_comments("SELECT article_id, round(sum(target * toxicity_annotator_count) / "
                         "nullif(sum(toxicity_annotator_count), 0), 9) AS weighted_avg FROM comments "
                         "WHERE target IS NOT NULL GROUP BY article_id")


def weighted_avg_lineitem(spark, sf_dir):
    out = E.weighted_average(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity",
                             by=["l_returnflag"])
    return out.select("l_returnflag", F.round("weighted_avg", 6).alias("weighted_avg"))


def weighted_avg_lineitem_sql():
    return ("SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / nullif(sum(l_quantity), 0), 6) "
            "AS weighted_avg FROM lineitem GROUP BY l_returnflag")


QUERIES = {
    "b1_b2_rename_keep": (rename_keep, rename_keep_sql),
    "b4_fill_numeric": (fill_numeric, fill_numeric_sql),
    "b5_to_bool": (to_bool, to_bool_sql),
    "b6_rule_table": (rule_table, rule_table_sql),
    "b8_identities_equal_one": (equal_one, equal_one_sql),
    "b9_b11_classes": (classes, classes_sql),
    "b12_label_matrix": (label_matrix, label_matrix_sql),
    "b13_label_tag_matrix": (label_tag_matrix, label_tag_matrix_sql),
    "b17_softmax": (softmax, softmax_sql),
    "b18_hour_of_day": (hour, hour_sql),
    "b19_one_hot": (one_hot, one_hot_sql),
    "b20_label_index": (label_index, label_index_sql),
    "c4_long_comments": (long_comments, long_comments_sql),
    "c5_articles_mean_one": (articles_mean_one, articles_mean_one_sql),
    "c6_tag_count_filters": (tag_count_filters, tag_count_filters_sql),
    "c7_subgroup_masks": (subgroup_masks, subgroup_masks_sql),
    "c8_drop_missing_text": (drop_missing, drop_missing_sql),
    "c9_head": (head10, head10_sql),
    "c10_row_at": (row_at, row_at_sql),
    "i1_describe": (describe, describe_sql),
    "i1_describe_lineitem": (describe_lineitem, describe_lineitem_sql),
    "i2_article_means": (article_means, article_means_sql),
    "i3_identity_counts": (identity_counts, identity_counts_sql),
    "i17_ranked_identities": (ranked_identities, ranked_identities_sql),
    "i4_identity_toxicity": (identity_toxicity, identity_toxicity_sql),
    "i5_tag_distribution": (tag_distribution, tag_distribution_sql),
    "i6_cooccurrence": (cooccurrence, cooccurrence_sql),
    "i7_hist_target": (hist_target, hist_target_sql),
    "i7_hist_reactions": (hist_reactions, hist_reactions_sql),
    "i7_hist_tag_count": (hist_tag_count, hist_tag_count_sql),
    "i7_hist_length": (hist_length, hist_length_sql),
    "i7_hist_hour": (hist_hour, hist_hour_sql),
    "i7_hist_lineitem": (hist_lineitem, hist_lineitem_sql),
    "i8_hist_by_identity": (hist_by_identity, hist_by_identity_sql),
    "i13_hist_article_means": (hist_article_means, hist_article_means_sql),
    "i9_corr_hour_toxicity": (corr_hour, corr_hour_sql),
    "i10_night_mean": (night_mean, night_mean_sql),
    "i11_label_frequency": (label_frequency, label_frequency_sql),
    "i12_distinct_classes": (distinct_classes, distinct_classes_sql),
    "i14_weighted_average": (weighted_avg, weighted_avg_sql),
    "i14_weighted_average_lineitem": (weighted_avg_lineitem, weighted_avg_lineitem_sql),
}
