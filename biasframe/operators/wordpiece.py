"""Longest-match-first pieces of words (F12), in one pass over a word.

A word is cut greedily: the longest piece that it starts with, then the longest
continuation piece that the rest starts with, and so on; a word that cannot be
cut to its end is the unknown piece as a whole. Trying every length at every
place costs the square of the length. Here the pieces form two tries (of first
and of continuation pieces) whose nodes have failure links: where a letter doesn't
continue a match, the node's link names the pieces that are then certain, and the
continuation node from which to go on with the same letter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A piece vocabulary is sent to all tasks; more pieces than this are refused.
MOST_PIECES = 500_000
MEMO_WORDS = 200_000
MARK = "##"


class Pieces:
    """The two tries; continuation pieces start with ``##``."""

    def __init__(self, pieces: Sequence[tuple[str, int]], unknown: int):
        self.unknown = unknown
        self.step: list[dict[str, int]] = [{}, {}]  # the roots: first pieces, continuations
        own: list[int] = [-1, -1]
        for text, i in pieces:
            at = 1 if text.startswith(MARK) and len(text) > len(MARK) else 0
            for c in text[len(MARK):] if at else text:
                to = self.step[at].get(c)
                if to is None:
                    to = self.step[at][c] = len(self.step)
                    self.step.append({})
                    own.append(-1)
                at = to
            own[at] = i
        n = len(self.step)
        self.link: list[int] = [-1] * n  # where to go on, -1: nowhere
        self.certain: list[tuple[int, ...]] = [()] * n
        queue = [0, 1]
        for u in queue:
            for c, v in self.step[u].items():
                if own[v] >= 0:
                    self.link[v], self.certain[v] = 1, (own[v],)
                else:
                    z, found = self.link[u], self.certain[u]
                    while z >= 0 and c not in self.step[z]:
                        found, z = found + self.certain[z], self.link[z]
                    if z >= 0:
                        self.link[v], self.certain[v] = self.step[z][c], found
                queue.append(v)

    def cut(self, word: str) -> list[int]:
        at, out, step = 0, [], self.step
        for c in word:
            while c not in step[at]:
                if self.link[at] < 0:
                    return [self.unknown]
                out += self.certain[at]
                at = self.link[at]
            at = step[at][c]
        while at > 1:  # the end of the word continues nothing
            if self.link[at] < 0:
                return [self.unknown]
            out += self.certain[at]
            at = self.link[at]
        return out


def encode_pieces(docs: DataFrame, words: str, pieces: DataFrame, unknown: int, out: str = "ids") -> DataFrame:
    """``docs`` with ``out``, the indexes of the pieces of all words of an array in
    order, in place of ``words``. ``pieces``: (piece, piece_index). No shuffle."""
    known = pieces.select("piece", "piece_index").limit(MOST_PIECES + 1).collect()
    if len(known) > MOST_PIECES:
        raise ValueError(f"a piece vocabulary has at most {MOST_PIECES} pieces")
    sent = docs.sparkSession.sparkContext.broadcast(sorted((r.piece, r.piece_index) for r in known))
    kept = [c for c in docs.columns if c not in (words, out)]
    places, at = [docs.columns.index(c) for c in kept], docs.columns.index(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, memo = Pieces(sent.value, unknown), {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                b = batch.slice(lo, 1000)
                coded = b.column(at).flatten().dictionary_encode()
                names = coded.dictionary.to_pylist()
                if len(memo) + len(names) > MEMO_WORDS:
                    memo.clear()
                for w in names:
                    if w not in memo:
                        memo[w] = table.cut(w)
                cuts = [memo[w] for w in names]
                size = np.array([len(c) for c in cuts], np.int64)
                flat = np.array([i for c in cuts for i in c], np.int64)
                code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
                lengths = pc.fill_null(pc.list_value_length(b.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                owner = np.repeat(np.arange(b.num_rows), lengths)[code >= 0]
                code = code[code >= 0]
                n = size[code] if len(code) else np.zeros(0, np.int64)
                first = (np.cumsum(size) - size)[code] if len(code) else n
                ids = flat[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())] if len(code) else np.zeros(0, np.int64)
                count = np.bincount(owner, n, b.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in places], pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int32()), pa.array(ids))],
                                                 names=[*kept, out])

    return docs.mapInArrow(run, T.StructType([*[docs.schema[c] for c in kept], T.StructField(out, T.ArrayType(T.LongType()))]))


def corpus_pieces(vocab: DataFrame, top: int = 3000, short: int = 4, first_index: int = 4) -> DataFrame:
    """(piece, piece_index): a piece vocabulary from a word vocabulary (F4): its
    ``top`` words, those of at most ``short`` letters as continuations too, and
    every letter of these words as either."""
    words = vocab.where(F.col("word_index") <= top).select("word")
    letters = words.select(F.explode(F.split("word", "")).alias("word")).where("word <> ''")
    some = words.where(F.length("word") <= short).unionByName(letters).select(F.concat(F.lit(MARK), F.col("word")).alias("piece"))
    every = words.unionByName(letters).select(F.col("word").alias("piece")).unionByName(some).distinct()
    from biasframe.operators.ordering import dense_index
    return dense_index(every, ["piece"], name="_i").select("piece", (F.col("_i") + first_index).alias("piece_index"))
