"""Tokenising, vocabulary fit and sequence encoding.

The vocabulary is ranked by descending count, ties by first appearance in the
corpus (document order, then token position), indexes from 1. Counting is a
grouped aggregation over exploded tokens (a frequent word is combined
map-side); ranking is a distributed sort of the distinct words
(``dense_index``), never a single-task window.

Encoding looks up the words of each document in place (``gather``): the commonest
words of the vocabulary are sent to all tasks, of the others each document asks
for every distinct one once.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biasframe.operators.gather import encode_arrays, known_counts
from biasframe.operators.ordering import attach_row, dense_index

# --- fixed values (tokenizer defaults the reference relies on) -------------
DEFAULT_FILTERS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'
NEWLINE_TAB_FILTERS = "\n\t"
# --- end of fixed values ----------------------------------------------------
#: A place in the corpus as one number.
_PLACE = "decimal(38,0)"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str, filters: str = DEFAULT_FILTERS, lower: bool = True) -> Column:
    """Tokenizer word sequence: lower-case, filter characters -> space, split
    on single spaces, drop empty pieces. The text stands in it once: Spark computes again
    what a condition and its branch share."""
    t = F.coalesce(_c(text), F.lit(""))
    if lower:
        t = F.lower(t)
    if filters:
        t = F.translate(t, filters, " " * len(filters))
    return F.array_remove(F.split(F.trim(F.regexp_replace(t, " +", " ")), " "), "")


def corpus(parts: Sequence[DataFrame], id_col: str = "id", text: str = "text") -> DataFrame:
    """bag union of several text tables, keeping the document order
    (part number, then id) that the vocabulary tie-break needs."""
    out = None
    for i, p in enumerate(parts):
        d = p.select(F.lit(i).alias("part"), F.col(id_col).alias("doc"), F.col(text).alias("text"))
        out = d if out is None else out.unionByName(d)
    return out


def tokenize(corp: DataFrame, filters: str = DEFAULT_FILTERS, lower: bool = True) -> DataFrame:
    """(part, doc, pos, word): one row per token of a ``corpus`` frame."""
    return corp.select("part", "doc", F.posexplode(tokens("text", filters, lower)).alias("pos", "word"))


def vocabulary_from_tokens(tok: DataFrame) -> DataFrame:
    """(word, word_count, word_index) from ``tokenize`` rows.

    One hash aggregation: the count, and the first appearance as the least of one
    fixed-width number that holds part, document and position. Both are combined
    map-side, so what is shuffled is a row per distinct word and task."""
    return _ranked(tok.select("word", _first_place().alias("_base"), "pos"))


def _first_place() -> Column:
    """The place of a document's first token in the corpus as one number: the part,
    then the 64-bit id, then ten digits for the position."""
    part, doc = F.col("part").cast("long").cast(_PLACE), F.col("doc").cast("long").cast(_PLACE)
    return part * F.lit(Decimal(10**30)) + (doc + F.lit(Decimal(2**63))) * F.lit(Decimal(10**10))


def _ranked(tok: DataFrame) -> DataFrame:
    stats = tok.groupBy("word").agg(F.count(F.lit(1)).alias("word_count"), F.min((F.col("_base") + F.col("pos")).cast(_PLACE)).alias("_first"))
    ranked = dense_index(stats, [F.desc("word_count"), F.asc_nulls_last("_first"), F.col("word")], name="_r")
    return ranked.select("word", "word_count", (F.col("_r") + 1).alias("word_index"))


def fit_vocabulary(corp: DataFrame, filters: str = DEFAULT_FILTERS, lower: bool = True) -> DataFrame:
    """(word, word_count, word_index) over a ``corpus`` frame."""
    return _ranked(corp.select(_first_place().alias("_base"), F.posexplode(tokens("text", filters, lower)).alias("pos", "word")))


def vocabulary_size(vocab: DataFrame) -> DataFrame:
    """``len(word_index) + 1`` (index 0 is padding)."""
    return vocab.agg((F.count(F.lit(1)) + 1).alias("vocab_size"))


def encode(docs: DataFrame, vocab: DataFrame, id_col: str = "id", text: str = "text",
           filters: str = DEFAULT_FILTERS, lower: bool = True, num_words: int | None = None,
           out: str = "ids") -> DataFrame:
    """Word ids in text order, a row for every row of ``docs``; unknown words
    (and, with ``num_words``, indexes >= num_words) are dropped."""
    return encode_arrays(docs.select(id_col, tokens(text, filters, lower).alias("_words")), "_words", vocab, num_words, out)


def max_length(seqs: DataFrame, col: str = "ids") -> DataFrame:
    """longest sequence."""
    return seqs.agg(F.coalesce(F.max(F.size(col)), F.lit(0)).alias("max_len"))


def longest_known(docs: DataFrame, words: str, vocab: DataFrame) -> DataFrame:
    """F9 without encoding: the largest number of known words of a row (an array of
    ``words`` each). Each row's distinct words are counted in place, the less common ones
    looked up with their counts."""
    known = known_counts(docs, words, vocab).groupBy("_row").agg(F.sum("n").alias("_n"))
    return known.agg(F.coalesce(F.max("_n"), F.lit(0)).alias("max_len"))


def pad_post(ids: Column | str, length: Column | int) -> Column:
    """post-pad with 0 to ``length`` (longer lists keep their last items,
    the tokenizer's default truncation side)."""
    c = _c(ids)
    n = F.lit(length) if isinstance(length, int) else length
    kept = F.when(F.size(c) > n, F.slice(c, F.size(c) - n + 1, n)).otherwise(c)
    return F.concat(kept, F.array_repeat(F.lit(0), F.greatest(n - F.size(kept), F.lit(0))))


def pad_pre(ids: Column | str, length: int) -> Column:
    """keep the last ``length`` ids and pre-pad with 0."""
    c = _c(ids)
    n = F.lit(length)
    kept = F.when(F.size(c) > n, F.slice(c, F.size(c) - n + 1, n)).otherwise(c)
    return F.concat(F.array_repeat(F.lit(0), n - F.size(kept)), kept)


def pad_to_longest(seqs: DataFrame, col: str = "ids", out: str = "padded") -> DataFrame:
    """F9 + F10: post-pad every sequence to the longest one (a one-row
    aggregate attached to the rows)."""
    return attach_row(seqs, max_length(seqs, col)).withColumn(out, pad_post(col, F.col("max_len"))).drop("max_len")


def model_inputs(ids: Column | str, max_len: int, cls_id: Column | int, sep_id: Column | int) -> list[Column]:
    """fixed-length input ids ``[CLS] + ids[:max_len-2] + [SEP]``, zero
    padded, with the attention mask and the segment ids."""
    c = _c(ids)
    cls_c = F.lit(cls_id) if isinstance(cls_id, int) else cls_id
    sep_c = F.lit(sep_id) if isinstance(sep_id, int) else sep_id
    body = F.slice(c, 1, max_len - 2)
    seq = F.concat(F.array(cls_c), body, F.array(sep_c))
    pad = F.array_repeat(F.lit(0), F.lit(max_len) - F.size(seq))
    return [F.concat(seq, pad).alias("input_ids"),
            F.concat(F.array_repeat(F.lit(1), F.size(seq)), pad).alias("input_mask"),
            F.array_repeat(F.lit(0), max_len).alias("segment_ids")]


def sentences(text: Column | str) -> Column:
    """F2 (re-aimed, rule based): split after ``.``, ``!`` or ``?`` followed by
    whitespace; empty pieces dropped."""
    from biasframe.functions.text import JAVA_WS
    marked = F.regexp_replace(F.coalesce(_c(text), F.lit("")), "(?U)([.!?])" + JAVA_WS + "+", "$1\u0001")
    parts = F.split(marked, "\u0001")
    return F.filter(parts, lambda s: F.trim(s) != "")
