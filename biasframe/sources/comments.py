"""The ``comments`` table: the annotated-comments schema laid over the
provided ``documents``, ``labels`` and ``events`` tables.

Row ``n`` (= ``doc_id``) gets deterministic annotation columns computed by
integer arithmetic only, so the same rows can be written as a DuckDB view
(``comments_sql``) for the oracle. Joins are plain equi-joins on the key:
at scale they run as sort-merge joins, and AQE turns a side into a
broadcast at run time only when its measured size is under the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biasframe.schema import IDENTITY_COLUMNS, REACTION_COLUMNS, SUBTYPE_COLUMNS
from biasframe.operators.ordering import spread
from biasframe.sources.tables import table

# --- fixed values of the stand-in (FIXTURES.md §2) ---------------------------
NOISY_SUFFIXES = [" :-( sad <3", " ;-) wink", " see http://a.b/c?d=1 ok",
                  " I don't  know 42", " stop!!! ** ... male female", ""]
# --- end of fixed values -----------------------------------------------------


def _identity(n: Column, k: int) -> Column:
    r = ((n + k) * (2 * k + 3)) % 11
    return (F.when(n % 4 == 0, F.lit(None).cast("double"))
             .when(r < 5, F.lit(0.0))
             .otherwise((r - 4) / F.lit(6.0)))


def comments_frame(documents: DataFrame, labels: DataFrame, events: DataFrame | None) -> DataFrame:
    """``events`` may be None when ``created_date`` is not needed: the event
    key is unique, so the left join adds a column and never rows."""
    d = spread(documents.select("doc_id", "text", "lang", "source"), "doc_id")
    lab = labels.select(F.col("doc_id").alias("_l_doc"), "toxic")
    j = d.join(lab, d.doc_id == lab._l_doc, "left")
    if events is not None:
        ev = events.select(F.col("event_id").alias("_e_id"), "ts")
        j = j.join(ev, d.doc_id == ev._e_id, "left")
    else:
        j = j.withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    n = F.col("doc_id")
    labelled = F.col("_l_doc").isNotNull()
    suffix = F.element_at(F.array(*[F.lit(s) for s in NOISY_SUFFIXES]), (n % 6 + 1).cast("int"))
    cols = [n.alias("id"), F.col("text").alias("comment_text"),
            F.concat(F.col("text"), suffix).alias("noisy_text"),
            F.col("lang"), F.col("source").alias("article_id"),
            F.col("ts").alias("created_date"),
            F.when(labelled, F.col("toxic") * 0.5 + (n * 37 % 50) / F.lit(100.0)).alias("target")]
    cols += [_identity(n, k).alias(c) for k, c in enumerate(IDENTITY_COLUMNS)]
    cols += [((n * (k + 3)) % 17 / F.lit(16.0)).alias(c) for k, c in enumerate(SUBTYPE_COLUMNS)]
    cols += [((n * (k + 2)) % (k + 5)).cast("int").alias(c) for k, c in enumerate(REACTION_COLUMNS)]
    cols += [((n * 5) % 9 / F.lit(8.0)).alias("sexual_explicit"),
             (n % 12 + 1).cast("int").alias("toxicity_annotator_count"),
             (n % 4).cast("int").alias("identity_annotator_count"),
             F.when(n % 5 == 0, F.lit("rejected")).otherwise(F.lit("approved")).alias("rating"),
             F.when(labelled, F.col("toxic") * 0.25 + (n * 53 % 64) / F.lit(128.0)).alias("score")]
    return j.select(*cols)


def comments(spark: SparkSession, sf_dir: str, with_time: bool = False) -> DataFrame:
    """``events`` are joined only for queries that need ``created_date`` (NULL otherwise)."""
    return comments_frame(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                          table(spark, sf_dir, "events") if with_time else None)


def sql_quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def comments_sql() -> str:
    """The same rows as a DuckDB/ANSI query (used by the oracle)."""
    n = "d.doc_id"
    suffix = " ".join(f"WHEN {i} THEN {sql_quote(s)}" for i, s in enumerate(NOISY_SUFFIXES))
    parts = [f"{n} AS id", "d.text AS comment_text",
             f"d.text || (CASE {n} % 6 {suffix} END) AS noisy_text",
             "d.lang AS lang", "d.source AS article_id", "e.ts AS created_date",
             f"CASE WHEN l.doc_id IS NULL THEN NULL ELSE 0.5e0 * l.toxic + (({n} * 37) % 50) / 100.0e0 END AS target"]
    for k, c in enumerate(IDENTITY_COLUMNS):
        r = f"((({n} + {k}) * {2 * k + 3}) % 11)"
        parts.append(f"CASE WHEN {n} % 4 = 0 THEN NULL WHEN {r} < 5 THEN 0.0e0 "
                     f"ELSE ({r} - 4) / 6.0e0 END AS {c}")
    for k, c in enumerate(SUBTYPE_COLUMNS):
        parts.append(f"(({n} * {k + 3}) % 17) / 16.0e0 AS {c}")
    for k, c in enumerate(REACTION_COLUMNS):
        parts.append(f"CAST(({n} * {k + 2}) % {k + 5} AS INTEGER) AS {c}")
    parts += [f"(({n} * 5) % 9) / 8.0e0 AS sexual_explicit",
              f"CAST(1 + {n} % 12 AS INTEGER) AS toxicity_annotator_count",
              f"CAST({n} % 4 AS INTEGER) AS identity_annotator_count",
              f"CASE WHEN {n} % 5 = 0 THEN 'rejected' ELSE 'approved' END AS rating",
              f"CASE WHEN l.doc_id IS NULL THEN NULL ELSE 0.25e0 * l.toxic + (({n} * 53) % 64) / 128.0e0 END AS score"]
    return ("SELECT " + ",\n  ".join(parts)
            + "\nFROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"
              " LEFT JOIN events e ON e.event_id = d.doc_id")


def with_comments(sql: str) -> str:
    """Prefix a query over ``comments`` with the view as a CTE."""
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        return f"WITH comments AS (\n{comments_sql()}\n),\n{body[5:]}"
    return f"WITH comments AS (\n{comments_sql()}\n)\n{body}"
