"""Quality rules with adaptive thresholds (operator 2), DataFrame functions only.

Per language and source, each measure of a text has a mergeable quantile
sketch: a count per log-linear cell (the leading bits of the value), so merging
is adding counts and every quantile is known to one part in 64. A group's sketch is
blended with that of its language, and this with that of all texts, as if each
stood for ``PRIOR`` more texts: small groups lean on their language, large ones go by
their own, with no size at which the rule changes. The sketches hold the texts that
pass the base rules. Word length, which has no heap at zero, comes first: its cutoffs are
fences around the quartiles of the group. The other measures take the cutoff
from the texts well inside those fences, whose lists and symbols are the usual ones: their
quantile ``TOP``, and one step of the sketch (1/64 of the value and of the scale) beyond.
The cutoffs are joined back to the measures to filter.

Defined cases: a null text has no words; texts without words fail the base
rules and stay out of the sketches; null languages and sources are groups of
their own; a group of which no text passes the base rules keeps none; texts of
any length are measured whole; an empty table gives an empty result; repeated
rows are measured and counted each; other columns are not read, so their names
cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biasframe.llm.common import WORD_GAP, let, word_array, written

SYMBOLS = "#*$%&|<>"
#: Leading bits of a value that name its cell: a relative error of 1/64.
CELL_BITS = 7
SHARES, LENGTH = ["symbols_ppm", "dup_lines_ppm", "repeats_ppm"], "word_milli"
#: Texts that the sketch of a group's language counts for, in units of WEIGHT; one text's weight.
PRIOR, WEIGHT = 200, 1_000_000
#: Quartile spreads to the fences of word length, and of the texts that set the other cutoffs.
FENCE, INNER = 3, 1
#: The quantile of these texts, in thousandths, and a step of the sketch on the scale of shares.
TOP, STEP = 990, 1_000_000 >> 6


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every text, in one pass."""
    symbols = F.length("text") - F.length(F.translate("text", SYMBOLS, ""))
    words = docs.select("doc_id", "lang", "source", F.coalesce(symbols, F.lit(0)).cast("long").alias("n_symbols"), word_array(F.col("text")).alias("_w"),
                        F.filter(F.split(F.coalesce("text", F.lit("")), "\n"),
                                 lambda x: F.length(F.btrim(x, F.lit(WORD_GAP))) > 0).alias("_l"))
    words = words.select("*", F.array_join("_w", "").alias("_c"), F.size("_w").cast("long").alias("n_words"))
    m = F.greatest(F.size("_w") - 2, F.lit(0))
    windows = F.arrays_zip(F.slice("_w", F.lit(1), m).alias("a"), F.slice("_w", F.lit(2), m).alias("b"),
                           F.slice("_w", F.lit(3), m).alias("c"), F.sequence(F.lit(1), m).alias("i"))
    none = F.expr("cast(array() as array<struct<a:string,b:string,c:string,i:int>>)")
    sized = words.select(
        "doc_id", "lang", "source", "n_words", F.length("_c").cast("long").alias("word_chars"),
        "n_symbols",
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_w") > 2, F.sort_array(windows)).otherwise(none).alias("_s"))
    # equal windows are neighbours now; keep the places of those with an equal neighbour
    same = F.filter(F.arrays_zip(F.col("_s").alias("x"), F.slice("_s", F.lit(2), F.greatest(F.size("_s") - 1, F.lit(0))).alias("y")),
                    lambda z: (z["x"]["a"] == z["y"]["a"]) & (z["x"]["b"] == z["y"]["b"]) & (z["x"]["c"] == z["y"]["c"]))
    places = F.array_sort(F.array_union(F.transform(same, lambda z: z["x"]["i"]), F.transform(same, lambda z: z["y"]["i"])))
    kept = sized.select("doc_id", "lang", "source", "n_words", "word_chars", "n_lines", "n_dup_lines", "n_symbols", places.alias("_p"))
    # words covered by windows of three that start at the places
    covered = F.aggregate("_p", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-9).alias("last")),
                          lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).cast("long").alias("n"), p.alias("last")))["n"]
    return kept.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
                       covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _values() -> list[Column]:
    return [F.expr("1000000 * n_symbols div nullif(word_chars, 0)").alias("symbols_ppm"),
            F.expr("1000000 * n_dup_lines div nullif(n_lines, 0)").alias("dup_lines_ppm"),
            F.expr("1000000 * n_repeat_words div nullif(n_words, 0)").alias("repeats_ppm"),
            F.expr("1000 * word_chars div nullif(n_words, 0)").alias("word_milli")]


def cell(value: Column) -> Column:
    """The lower end of the log-linear cell of a value."""
    drop = F.greatest(F.length(F.bin(value)) - CELL_BITS, F.lit(0))
    return let(drop, lambda d: F.call_function("shiftleft", F.call_function("shiftright", value, d), d))


def sketches(valued: DataFrame, names: list[str]) -> DataFrame:
    """lang, source, measure, cell, n: the sketches of all groups. Counts are
    combined before the shuffle, so a hot source sends its cells, not its rows."""
    long = valued.select("lang", "source", F.explode(F.create_map(*[x for m in names for x in (F.lit(m), F.col(m))])).alias("measure", "value"))
    return long.groupBy("lang", "source", "measure", cell(F.col("value")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def _leaning(sketch: DataFrame, groups: DataFrame, shares: DataFrame, on: list[str]) -> DataFrame:
    """Sketches (on, measure, cell, n) of ``groups`` (on, measure) leaning on
    ``shares`` (of a coarser level, with the columns of ``on`` it knows): on,
    measure, cell, w."""
    known = [c for c in shares.columns if c in on]
    coarse = shares.select(*[F.col(c).alias(f"_{c}") for c in known], F.col("measure").alias("_m"), F.col("cell").alias("_cell"), "share")
    same = F.col("measure") == F.col("_m")
    for c in known:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    every = groups.join(coarse, same).select(*on, "measure", F.col("_cell").alias("cell"), "share")
    own = sketch.select(*[F.col(c).alias(f"_{c}") for c in on], F.col("measure").alias("_m"), F.col("cell").alias("_cell"), "n")
    same = (F.col("measure") == F.col("_m")) & (F.col("cell") == F.col("_cell"))
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    weight = F.coalesce("n", F.lit(0)) * WEIGHT + F.floor(PRIOR * WEIGHT * F.col("share")).cast("long")
    return every.join(own, same, "left").select(*on, "measure", "cell", weight.alias("w"))


def blended(valued: DataFrame, names: list[str], groups: DataFrame) -> DataFrame:
    """lang, source, measure, cell, below, total: the blended sketches of ``groups``
    (lang, source; some may have no row in ``valued``) as running weights. A window holds the cells of one sketch, some hundreds
    whatever the rows."""
    sketch = written(sketches(valued, names), "sketches")
    groups = groups.select("lang", "source", F.explode(F.array(*[F.lit(m) for m in names])).alias("measure"))
    by_all = sketch.groupBy("measure", "cell").agg(F.sum("n").alias("n"))
    shares = by_all.select("measure", "cell", (F.col("n") / F.sum("n").over(Window.partitionBy("measure"))).alias("share"))
    by_lang = _leaning(sketch.groupBy("lang", "measure", "cell").agg(F.sum("n").alias("n")), groups.select("lang", "measure").distinct(), shares, ["lang"])
    shares = by_lang.select("lang", "measure", "cell", (F.col("w") / F.sum("w").over(Window.partitionBy("lang", "measure"))).alias("share"))
    own = _leaning(sketch, groups, written(shares, "language_shares"), ["lang", "source"])
    w = Window.partitionBy("lang", "source", "measure")
    return own.select("lang", "source", "measure", "cell", F.sum("w").over(w.orderBy("cell")).alias("below"), F.sum("w").over(w).alias("total"))


def _quantile(part: int, of: int) -> Column:
    return F.min(F.when(of * F.col("below") >= part * F.col("total"), F.col("cell")))


def _fences(spreads: int) -> tuple[Column, Column]:
    """The ends of ``spreads`` quartile spreads around the quartiles, and a step of
    the sketch beyond."""
    return (F.expr(f"q1 - {spreads} * (q3 - q1) - shiftright(q1, 6)"), F.expr(f"q3 + {spreads} * (q3 - q1) + shiftright(q3, 6)"))


def _with(rows: DataFrame, groups: DataFrame, how: str) -> DataFrame:
    """Rows with the columns of their group, from a written table that the planner
    broadcasts only if its files are small."""
    named = groups.withColumnRenamed("lang", "_lang").withColumnRenamed("source", "_source")
    return rows.join(named, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), how).drop("_lang", "_source")


def cutoffs(valued: DataFrame) -> DataFrame:
    """lang, source, q1 and q3 of word length, and the cutoff of each share."""
    usual = valued.where(~F.col("base_failed"))
    groups = written(usual.select("lang", "source").distinct(), "groups")
    length = blended(usual, [LENGTH], groups).groupBy("lang", "source").agg(_quantile(1, 4).alias("q1"), _quantile(3, 4).alias("q3"))
    length = written(length, "word_lengths")
    low, high = _fences(INNER)
    inside = _with(usual, length, "inner").where((F.col(LENGTH) >= low) & (F.col(LENGTH) <= high))
    tops = blended(inside, SHARES, groups).groupBy("lang", "source", "measure").agg(_quantile(TOP, 1000).alias("q"))
    tops = tops.withColumn("high", F.expr(f"q + shiftright(q, 6) + {STEP}")).groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("measure") == m, F.col("high"))).alias(f"{m}_high") for m in SHARES])
    return written(_with(length, written(tops, "tops"), "left"), "cutoffs")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed and kept for every row of ``docs``. The measures (nine numbers a
    row) are written once; the texts are read once and never shuffled."""
    measured = written(measures(docs).select("*", base_failed().alias("base_failed")), "measures")
    valued = measured.select("*", *_values())
    joined = _with(valued, cutoffs(valued), "left")
    low, high = _fences(FENCE)
    inside = (F.col(LENGTH) >= low) & (F.col(LENGTH) <= high)
    for m in SHARES:
        inside = inside & (F.col(m) <= F.col(f"{m}_high"))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"))


def _blended_sql(name: str, rows: str, names: list[str]) -> str:
    cols = ", ".join(names)
    return f"""
{name}_sketch AS (SELECT lang, source, measure, (value >> s) << s AS cell, count(*) AS n FROM (SELECT *, greatest(length(bin(value)) - {CELL_BITS}, 0) AS s
  FROM (UNPIVOT (SELECT lang, source, {cols} FROM {rows}) ON {cols} INTO NAME measure VALUE value)) GROUP BY ALL),
{name}_groups AS (SELECT lang, source, unnest([{', '.join(f"'{m}'" for m in names)}]) AS measure FROM (SELECT DISTINCT lang, source FROM usual)),
{name}_all AS (SELECT measure, cell, n / sum(n) OVER (PARTITION BY measure) AS share FROM (SELECT measure, cell, sum(n)::BIGINT AS n FROM {name}_sketch GROUP BY ALL)),
{name}_lang AS (SELECT lang, measure, cell, w / sum(w) OVER (PARTITION BY lang, measure) AS share FROM (
  SELECT l.lang, a.measure, a.cell, coalesce(s.n, 0) * {WEIGHT} + floor({PRIOR * WEIGHT} * a.share)::BIGINT AS w
  FROM (SELECT DISTINCT lang, measure FROM {name}_groups) l JOIN {name}_all a USING (measure)
  LEFT JOIN (SELECT lang, measure, cell, sum(n)::BIGINT AS n FROM {name}_sketch GROUP BY ALL) s ON s.lang IS NOT DISTINCT FROM l.lang AND s.measure = a.measure AND s.cell = a.cell)),
{name}_own AS (SELECT g.lang, g.source, l.measure, l.cell, coalesce(s.n, 0) * {WEIGHT} + floor({PRIOR * WEIGHT} * l.share)::BIGINT AS w
  FROM {name}_groups g JOIN {name}_lang l ON l.lang IS NOT DISTINCT FROM g.lang AND l.measure = g.measure
  LEFT JOIN {name}_sketch s ON s.lang IS NOT DISTINCT FROM g.lang AND s.source IS NOT DISTINCT FROM g.source AND s.measure = l.measure AND s.cell = l.cell),
{name}_run AS (SELECT *, sum(w) OVER (PARTITION BY lang, source, measure ORDER BY cell) AS below, sum(w) OVER (PARTITION BY lang, source, measure) AS total FROM {name}_own)"""


def _between_sql(spreads: int) -> str:
    return f"{LENGTH} BETWEEN q1 - {spreads} * (q3 - q1) - (q1 >> 6) AND q3 + {spreads} * (q3 - q1) + (q3 >> 6)"


RULES_SQL = rf"""
WITH words AS (
  SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
windows AS (
  SELECT k, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS n FROM windows) WHERE n > 1),
covered AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY k),
measured AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN covered c USING (k)),
valued AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
         1000000 * n_symbols // word_chars AS symbols_ppm, 1000000 * n_dup_lines // n_lines AS dup_lines_ppm,
         1000000 * n_repeat_words // n_words AS repeats_ppm, 1000 * word_chars // n_words AS word_milli
  FROM measured),
usual AS (SELECT * FROM valued WHERE NOT base_failed),
{_blended_sql("w", "usual", [LENGTH])},
word AS (SELECT lang, source, min(CASE WHEN 4 * below >= total THEN cell END) AS q1, min(CASE WHEN 4 * below >= 3 * total THEN cell END) AS q3 FROM w_run GROUP BY ALL),
inside AS (SELECT u.* FROM usual u JOIN word f ON u.lang IS NOT DISTINCT FROM f.lang AND u.source IS NOT DISTINCT FROM f.source WHERE {_between_sql(INNER)}),
{_blended_sql("p", "inside", SHARES)},
tops AS (SELECT lang, source, measure, min(CASE WHEN 1000 * below >= {TOP} * total THEN cell END) AS q FROM p_run GROUP BY ALL),
fences AS (
  SELECT f.lang, f.source, q1, q3, {', '.join(f"max(CASE WHEN measure = '{m}' THEN q + (q >> 6) + {STEP} END) AS {m}_high" for m in SHARES)}
  FROM word f LEFT JOIN tops t ON f.lang IS NOT DISTINCT FROM t.lang AND f.source IS NOT DISTINCT FROM t.source GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce({' AND '.join(f'{m} <= {m}_high' for m in SHARES)} AND {_between_sql(FENCE)}, false) AS kept
FROM valued v LEFT JOIN fences f ON v.lang IS NOT DISTINCT FROM f.lang AND v.source IS NOT DISTINCT FROM f.source
"""
