"""Ranked lexical search by the Best Position Algorithm (operator 12).

Documents become blocks: the postings (document, occurrences) of each term of up
to ``BLOCK_DOCS`` documents. Numbers of documents and terms and the document
frequencies are summed over all blocks. A block meets the queries in
chunks: it is sent once and read before its chunks. There each term's postings
form an impact list, highest impact first. A query reads its lists from the
top; a document seen in one list is looked up in all others at once, which also
marks its positions there as seen. A list's best position is the end of its
stretch of seen positions from the top: no document unseen so far can have a
higher impact there than the one at that position. When the sum of these
impacts is strictly below the kth score, no unseen document can enter the top k
or tie with it. Scores are 64-bit integers, so the blocks' lists merge exactly.

The terms of the queries, where there are at most ``FILTER_TERMS``, are sent to all tasks
and only their postings are kept; beyond that blocks keep the postings of
all terms. Both give the same result.

Defined cases: null and empty texts and texts without a term count in nothing;
null ids are documents, last among equal scores; each repeated row is a document
of its own; rows of one item id are one item with the terms of all of them, null
ids too; items without a known term get no row; texts of any length are whole;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count as counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biasframe.llm.common import slices, written

BLOCK_DOCS = 16384
BLOCK_POSTINGS = 4_000_000
CHUNK_TERMS = 4096
FILTER_TERMS = 500_000
FIRST_DEPTH = 32
BUCKETS = 16
#: Digits and lower-case letters stay, upper-case letters become lower case, bytes of other characters stay.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BLOCK = "block long, ids binary, unnamed binary, lengths binary, terms array<string>, df array<long>, docs binary, tf binary"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LETTERS).split()


def query_terms(items: DataFrame) -> DataFrame:
    """item_id, term: the distinct terms of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, [1]) if b.num_rows else []:
                ids, terms = [], []
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    own = {w.decode("utf-8", "surrogatepass") for w in words_of(t)}
                    ids += [i] * len(own)
                    terms += own
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.string())], names=["item_id", "term"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, term string").distinct()


def index_blocks(docs: DataFrame, wanted: list[str] | None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Rows of BLOCK: documents in id order; terms in order, their document
    frequencies in the block, and their postings one after the other."""
    sent = None if wanted is None else docs.sparkSession.sparkContext.broadcast([t.encode("utf-8", "surrogatepass") for t in wanted])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        fixed = None if sent is None else {t: i for i, t in enumerate(sent.value)}
        number: dict = defaultdict(counter().__next__) if fixed is None else fixed
        ids: list[int | None] = []
        lengths: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal number, ids, lengths, keys, counts, made
            unnamed = np.array([i is None for i in ids], np.uint8)
            named = np.array([i or 0 for i in ids], np.int64)
            order = np.lexsort((named, unnamed))
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            key, tf = np.concatenate(keys), np.concatenate(counts)
            names = list(number) if fixed is None else sent.value
            used, code = np.unique(key & 0xFFFFFFFF, return_inverse=True)
            terms = [names[c] for c in used.tolist()]
            doc = place[key >> 32]
            by = np.lexsort((doc, code))
            out = pa.RecordBatch.from_arrays(
                [pa.array([task << 32 | made], pa.int64()), pa.array([named[order].tobytes()], pa.binary()), pa.array([unnamed[order].tobytes()], pa.binary()),
                 pa.array([np.concatenate(lengths)[order].tobytes()], pa.binary()), pa.array([[t.decode("utf-8", "surrogatepass") for t in terms]], pa.list_(pa.string())),
                 pa.array([np.bincount(code, minlength=len(used))], pa.list_(pa.int64())),
                 pa.array([doc[by].astype(np.int32).tobytes()], pa.binary()), pa.array([tf[by].astype(np.int32).tobytes()], pa.binary())],
                names=["block", "ids", "unnamed", "lengths", "terms", "df", "docs", "tf"])
            if fixed is None:
                number = defaultdict(counter().__next__)
            ids, lengths, keys, counts, made = [], [], [], [], made + 1
            return out

        for b in batches:
            for part in slices(b, [1]) if b.num_rows else []:
                words, n = [], []
                for t in part.column(1).to_pylist():
                    own = words_of(t)
                    words += own
                    n.append(len(own))
                codes = np.fromiter(map(number.get, words, repeat(-1)) if fixed is not None else map(number.__getitem__, words), np.int64, len(words))
                doc = np.repeat(np.arange(len(ids), len(ids) + len(n)), n)
                key, tf = np.unique((doc << 32 | codes)[codes >= 0], return_counts=True)
                ids += part.column(0).to_pylist()
                lengths.append(np.array(n, np.int64))
                keys.append(key)
                counts.append(tf)
                if len(ids) >= block_docs or sum(map(len, keys)) >= BLOCK_POSTINGS:
                    yield close()
        if ids:
            yield close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BLOCK)


class Lists:
    """The impact lists of a block; ``total`` and ``all_terms`` are N and L."""

    def __init__(self, ids: bytes, unnamed: bytes, lengths: bytes, terms: list[str], df: np.ndarray, docs: bytes, tf: bytes, total: int, all_terms: int):
        self.ids, self.unnamed = np.frombuffer(ids, np.int64), np.frombuffer(unnamed, np.uint8)
        self.number = {t: i for i, t in enumerate(terms)}
        self.first = np.r_[0, np.cumsum(df)].astype(np.int64)
        self.docs = np.frombuffer(docs, np.int32)
        n, tf = np.frombuffer(lengths, np.int64), np.frombuffer(tf, np.int32).astype(np.int64)
        m = 10 + 90 * n * total // max(all_terms, 1)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[self.docs])
        self.opened: dict[int, tuple] = {}

    def open(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
        """Of a term: the documents by impact, the impacts by position (0 behind the
        last), where the list is long the position of every document (the place
        behind the last for others), and the positions of its own documents."""
        found = self.opened.get(i)
        if found is None:
            docs, impact = self.docs[self.first[i]:self.first[i + 1]], self.impact[self.first[i]:self.first[i + 1]]
            order = np.argsort(-impact, kind="stable")
            place = np.empty(len(docs), np.int32)
            place[order] = np.arange(len(docs), dtype=np.int32)
            direct = None
            if 8 * len(docs) > len(self.ids):  # at most eight times the terms of a document have one
                direct = np.full(len(self.ids), len(docs), np.int32)
                direct[docs] = place
            found = self.opened[i] = docs[order], np.r_[impact[order], 0], direct, place
        return found

    def top(self, terms: list[str], weights: list[int], k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The places and scores of the k best documents, and the depth read."""
        use = [(self.number[t], w) for t, w in zip(terms, weights) if w > 0 and t in self.number]
        lists = [(i, w, *self.open(i)) for i, w in use]
        seen = np.zeros(len(self.ids), bool)
        score = np.zeros(len(self.ids), np.int64)
        marks = [np.zeros(len(by_impact) + 1, bool) for _, _, by_impact, _, _, _ in lists]
        best = [0] * len(lists)
        depth, step = 0, FIRST_DEPTH
        while lists:
            fresh = np.zeros(len(self.ids), bool)
            for _, _, by_impact, _, _, _ in lists:
                fresh[by_impact[depth:depth + step]] = True
            fresh &= ~seen
            new = np.flatnonzero(fresh)
            seen[new] = True
            depth, step = depth + step, step * 2
            sums = np.zeros(len(new), np.int64)
            for (i, w, _, impacts, direct, place), mark in zip(lists, marks):
                if direct is not None:
                    at = direct[new]
                    sums += w * impacts[at]
                    mark[at] = True
                else:  # a short list: its documents are looked up among the new ones
                    own = self.docs[self.first[i]:self.first[i + 1]]
                    here = np.flatnonzero(fresh[own])
                    sums[np.searchsorted(new, own[here])] += w * impacts[place[here]]
                    mark[place[here]] = True
            score[new] = sums
            bound = 0
            for j, ((_, w, by_impact, impacts, _, _), mark) in enumerate(zip(lists, marks)):
                n = len(by_impact)
                gap = np.flatnonzero(~mark[best[j]:n])
                best[j] = n if not len(gap) else best[j] + int(gap[0])
                bound += 0 if best[j] == n else w * int(impacts[best[j] - 1])
            if bound == 0 or (int(seen.sum()) >= k and bound < np.partition(score[seen], -k)[-k]):
                break
        hits = np.flatnonzero(seen & (score > 0))
        if len(hits) > k:
            hits = hits[score[hits] >= np.partition(score[hits], -k)[-k]]
        hits = hits[np.lexsort((hits, -score[hits]))][:k]
        return hits, score[hits], depth


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents for each item."""
    asked = written(query_terms(items), "query_terms")
    known = asked.select("term").distinct().limit(FILTER_TERMS + 1).collect()
    blocks = written(index_blocks(docs, sorted(r.term for r in known) if len(known) <= FILTER_TERMS else None, block_docs), "impact_blocks")
    return _search(blocks, asked, k)


def _search(blocks: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [np.frombuffer(x.as_py(), np.int64) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([int((x > 0).sum()) for x in n], pa.int64()), pa.array([int(x.sum()) for x in n], pa.int64())], names=["n", "l"])

    total, all_terms = blocks.select("lengths").mapInArrow(totals, "n long, l long").agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0))).first()
    pair = F.explode(F.arrays_zip("terms", "df")).alias("_p")
    df = blocks.select(pair).groupBy(F.col("_p.terms").alias("term")).agg(F.sum("_p.df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * total + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = written(asked.join(df, "term").select("item_id", "term", weight.alias("w")), "query_weights")
    chunks = max(1, -(-weighted.count() // CHUNK_TERMS))
    chunk = F.pmod(F.xxhash64(F.lit(12), "item_id"), F.lit(chunks)).alias("_chunk")
    queries = weighted.groupBy(chunk, "item_id").agg(F.collect_list(F.struct("term", "w")).alias("own")) \
        .groupBy("_chunk").agg(F.collect_list(F.struct("item_id", F.col("own.term").alias("terms"), F.col("own.w").alias("ws"))).alias("asked"))
    names = [f.name for f in blocks.schema]
    # a chunk goes to every block: the block list is joined by bucket, its payload stays away
    bucket = F.pmod(F.xxhash64("block"), F.lit(BUCKETS))
    spread = queries.withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))))
    sent = blocks.select("block", bucket.cast("int").alias("_bucket")).join(spread, "_bucket")
    asked_type = queries.schema["asked"].dataType
    first = blocks.select(*names, F.lit(None).cast(asked_type).alias("asked"), F.lit(0).alias("_step"))
    later = sent.select("block", *[F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in names[1:]], "asked", F.lit(1).alias("_step"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, own = None, None
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(i)[r] for i, c in enumerate(b.schema.names)}
                if row["_step"].as_py() == 0:
                    lists, own = Lists(row["ids"].as_py(), row["unnamed"].as_py(), row["lengths"].as_py(), row["terms"].as_py(),
                                       row["df"].values.to_numpy(), row["docs"].as_py(), row["tf"].as_py(), total, all_terms), row["block"].as_py()
                    continue
                assert own == row["block"].as_py()
                items, docs, scores = [], [], []
                for q in row["asked"].as_py():
                    at, score, _ = lists.top(q["terms"], q["ws"], k)
                    items += [q["item_id"]] * len(at)
                    docs += [None if u else i for i, u in zip(lists.ids[at].tolist(), lists.unnamed[at].tolist())]
                    scores += score.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(docs, pa.int64()), pa.array(scores, pa.int64())], names=["item_id", "doc_id", "score"])

    streamed = first.unionByName(later).repartition(F.col("block")).sortWithinPartitions("block", "_step")
    found = streamed.mapInArrow(run, "item_id long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


SEARCH_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
tot AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, asked.term, floor(1000 * ln((2 * tot.docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM asked JOIN df USING (term), tot),
m AS (SELECT doc_id, 10 + (90 * len.n * tot.docs) // tot.terms AS m FROM len, tot),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
