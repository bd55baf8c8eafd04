"""Language-model scores from an Elias-Fano n-gram trie (operator 4).

Texts become blocks of about ``BLOCK_TOKENS`` word codes. Words, then word
pairs, are counted over all training texts by shards: every block sends its
distinct keys to the shards of a hash, and gets the answers back in the same
order, so what moves is compact and no key, however common, is hot. A shard of
pairs is a trie: the contexts and the pointers to their successors are monotone
sequences in Elias-Fano form, the successors of all contexts form one more (each
relative to its context's range), and every successor has an 8-bit quantised
probability. The levels lie in one memory-mapped block; the distinct pairs of all
blocks are looked up once in a shard, sorted, by successor search within the
range of their context, and each block gets its answers by position.

P(w | v) = (c(v w) + MASS * P(w)) / (c(v) + MASS), P(w) = (c(w) + 1) / (N + V + 1):
the more often a context was seen, the more its pairs count against the words
alone, so a pair seen twice after a rare word is far likelier than one seen once.
After a word unknown in training this is P(w). The trie stores c(v w) / (c(v) + MASS),
quantised; a pair unseen in training has only the second part.

Defined cases: null text counts as empty; an empty text is its end token; with
no training text every count is 0; repeated rows count and are scored each;
null ids count as training rows; texts of any length are whole (a text longer
than a block is a block of its own); an empty table gives an empty result;
other columns are not read. Word ids are 32-bit.
"""

from __future__ import annotations

import mmap
import tempfile
from collections import defaultdict
from collections.abc import Iterator
from itertools import count as counter

import numpy as np
import pandas as pd
import pyarrow as pa
import uuid
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biasframe.llm.common import release_memory, scratch, written
from biasframe.llm.near_dup import mixed

BLOCK_TOKENS = 2_000_000
SHARD_KEYS = 2_000_000
MASS = 4.0  # of the words alone, in occurrences of the context
STEP, MISS = 0.04, 255  # of the quantised decimal logarithms
END, START = b" ", b"\n"  # no word has white space
_U = np.uint64
START_HASH = xxhash.xxh3_64_intdigest(START)


def pack(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 1)


def unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), dtype)


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a.astype(_U), prepend=_U(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, _U), dtype=_U)


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary."""

    def __init__(self, head: np.ndarray, high: np.ndarray, low: np.ndarray):
        self.n, self.bits = int(head[0]), int(head[1])
        self.high, self.low = high, low
        self.ones = np.cumsum(np.bitwise_count(high), dtype=np.int64)

    @staticmethod
    def build(values: np.ndarray) -> list[np.ndarray]:
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        place = (values >> _U(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros((int(place[-1]) // 64 + 1 if n else 0) * 64, np.uint8)
        unary[place] = 1
        high = np.packbits(unary, bitorder="little").view(_U)
        lows = (values[:, None] >> np.arange(bits, dtype=_U) & _U(1)).astype(np.uint8) if bits else np.zeros((n, 0), np.uint8)
        return [np.array([n, bits], np.int64), high, np.packbits(lows.reshape(-1), bitorder="little")]

    def decode(self, lo: int, hi: int) -> np.ndarray:
        """Values lo to hi - 1."""
        if hi <= lo:
            return np.zeros(0, _U)
        first = int(np.searchsorted(self.ones, lo, side="right"))
        last = int(np.searchsorted(self.ones, hi - 1, side="right")) + 1
        skipped = int(self.ones[first - 1]) if first else 0
        places = np.flatnonzero(np.unpackbits(self.high[first:last].view(np.uint8), bitorder="little"))[lo - skipped:hi - skipped]
        out = (places + 64 * first - np.arange(lo, hi)).astype(_U) << _U(self.bits)
        if self.bits:
            a, b = lo * self.bits, hi * self.bits
            flat = np.unpackbits(self.low[a // 8:-(-b // 8)], bitorder="little")[a % 8:a % 8 + b - a]
            wide = np.zeros((hi - lo, 64), np.uint8)
            wide[:, :self.bits] = flat.reshape(hi - lo, self.bits)
            out |= np.packbits(wide, axis=1, bitorder="little").view(_U)[:, 0]
        return out

    def successors(self, sorted_queries: np.ndarray, piece: int = 32768) -> tuple[np.ndarray, np.ndarray]:
        """For each query the index of the first value not below it (n if none),
        and that value; only one piece of the sequence is decoded at a time."""
        index = np.full(len(sorted_queries), self.n, np.int64)
        value = np.zeros(len(sorted_queries), _U)
        at = 0
        for lo in range(0, self.n, piece):
            v = self.decode(lo, min(lo + piece, self.n))
            to = int(np.searchsorted(sorted_queries, v[-1], side="right"))
            if to > at:
                k = np.searchsorted(v, sorted_queries[at:to])
                index[at:to], value[at:to] = lo + k, v[k]
                at = to
        return index, value


class Trie:
    """One shard: contexts, pointers, successors and probabilities, mapped."""

    def __init__(self, block: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(block)
            f.flush()
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        view, at, parts = memoryview(self._map), 8 * 11, []
        sizes = np.frombuffer(view[:at], np.int64)
        for k, size in enumerate(sizes[:10]):
            raw = np.frombuffer(view[at:at + int(size)], np.uint8)
            parts.append(raw if k in (2, 5, 8, 9) else raw.view(np.int64 if k % 3 == 0 else _U))
            at += -(-int(size) // 8) * 8
        self.contexts, self.pointers, self.words = (EliasFano(*parts[k:k + 3]) for k in (0, 3, 6))
        self.codes, self.span = parts[9], int(sizes[10])

    @staticmethod
    def build(context: np.ndarray, word: np.ndarray, codes: np.ndarray) -> bytes:
        """From pairs sorted by context, then word."""
        heads, first = np.unique(context, return_index=True)
        span = int(word.max(initial=0)) + 1
        rank = np.repeat(np.arange(len(heads)), np.diff(np.r_[first, len(context)])).astype(_U)
        parts = [*EliasFano.build(heads), *EliasFano.build(np.r_[first, len(context)].astype(_U)),
                 *EliasFano.build(rank * _U(span) + word), codes.astype(np.uint8)]
        blobs = [p.tobytes() for p in parts]
        body = b"".join(b + b"\0" * (-len(b) % 8) for b in blobs)
        return np.array([*map(len, blobs), span], np.int64).tobytes() + body

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The codes of sorted pairs, MISS where a pair is not stored."""
        out = np.full(len(context), MISS, np.uint8)
        if not self.contexts.n:
            return out
        asked, where = np.unique(context, return_inverse=True)
        rank, found = self.contexts.successors(asked)
        known = (rank < self.contexts.n) & (found == asked)
        use = np.flatnonzero(known[where] & (word < self.span))
        target = rank[where[use]].astype(_U) * _U(self.span) + word[use]
        index, value = self.words.successors(target)
        ends = self.pointers.decode(0, self.pointers.n)[rank[where[use]] + 1] if len(use) else np.zeros(0, _U)
        hit = (value == target) & (index < ends.astype(np.int64))
        out[use[hit]] = self.codes[index[hit]]
        return out


def text_blocks(docs: DataFrame, held: Column) -> DataFrame:
    """block, ids, held, lengths, codes, keys: texts as codes into the sorted
    distinct word hashes of their block; each text ends with the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        number: dict[bytes, int] = defaultdict(counter().__next__)
        ids, marks, texts, total = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal number, ids, marks, texts, total, made
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, number), _U, len(number))
            keys, new = np.unique(np.r_[hashes, _U(START_HASH)], return_inverse=True)
            codes = new[np.concatenate(texts)].astype(np.int32)
            out = pa.RecordBatch.from_arrays(
                [pa.array([task << 32 | made], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([pack(np.array(marks, np.uint8))], pa.binary()),
                 pa.array([pack(np.array([len(t) for t in texts], np.int32))], pa.binary()), pa.array([pack(codes)], pa.binary()),
                 pa.array([pack_sorted(keys)], pa.binary()), pa.array([len(keys)], pa.int64())],
                names=["block", "ids", "held", "lengths", "codes", "keys", "n_keys"])
            number, ids, marks, texts, total, made = defaultdict(counter().__next__), [], [], [], 0, made + 1
            release_memory()
            return out

        for b in batches:
            for i, t, h in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                words = (t.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                words.append(END)
                ids.append(i)
                marks.append(h)
                texts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                total += len(words)
                if total >= BLOCK_TOKENS:
                    yield close()
        if ids:
            yield close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held")).mapInArrow(
        run, "block long, ids array<long>, held binary, lengths binary, codes binary, keys binary, n_keys long")


class Block:
    """A decoded row of ``text_blocks``."""

    def __init__(self, row: dict):
        self.keys, self.codes = unpack_sorted(row["keys"]), unpack(row["codes"], np.int32)
        self.lengths, self.held = unpack(row["lengths"], np.int32), unpack(row["held"], np.uint8)
        self.train = np.repeat(self.held == 0, self.lengths)
        self.start = int(np.searchsorted(self.keys, _U(START_HASH)))
        self.ids = row["ids"]

    def counts(self) -> np.ndarray:
        n = np.bincount(self.codes[self.train], minlength=len(self.keys))
        n[self.start] += int((self.held == 0).sum())  # as a context
        return n

    def pairs(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct (context, word) keys, and each token's place there."""
        before = np.empty_like(self.codes)
        before[1:] = self.codes[:-1]
        before[np.cumsum(self.lengths) - self.lengths] = self.start
        return np.unique(ids[before] << _U(32) | ids[self.codes], return_inverse=True)


def _by_shard(shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each shard that occurs, in order."""
    by = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[by], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        yield s, by[cuts[s]:cuts[s + 1]]


def _answers(row: dict, name: str, dtypes: list, shard_of: np.ndarray) -> list[np.ndarray]:
    """The shards' answers of a block in the order of its keys."""
    out = [np.zeros(len(shard_of), d) for d in dtypes]
    sent = {a["shard"]: a for a in row[name]}
    for s, at in _by_shard(shard_of, max(sent, default=0) + 1):
        for k, o in enumerate(out):
            o[at] = unpack(sent[s][f"v{k}"], dtypes[k])
    return out


def _with_answers(blocks: DataFrame, answers: DataFrame, name: str, values: int) -> DataFrame:
    """Blocks with the list of their shards' answers: bounded by the block."""
    listed = answers.groupBy("block").agg(F.collect_list(F.struct("shard", *[f"v{k}" for k in range(values)])).alias(name))
    return blocks.join(listed, "block")


def count_words(blocks: DataFrame, shards: int) -> DataFrame:
    """block, shard, v0 (word ids), v1 (training counts); block -1: N and V."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                b = Block(row)
                n, shard = b.counts(), (mixed(b.keys) % _U(shards)).astype(int)
                for s, at in _by_shard(shard, shards):
                    yield pd.DataFrame({"shard": [s], "block": [row["block"]], "keys": [pack_sorted(b.keys[at])], "n": [pack(n[at].astype(np.uint32))]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        keys = [unpack_sorted(x) for x in pdf["keys"]]
        every, where = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(where, np.concatenate([unpack(x, np.uint32) for x in pdf["n"]]), len(every)).astype(np.int64)
        ids = np.empty(len(every), np.int64)
        ids[np.lexsort((every, -n))] = np.arange(len(every)) * shards + shard  # common words have small ids
        words = every != _U(START_HASH)
        out = [{"block": -1, "shard": shard, "v0": pack(np.array([n[words].sum()])), "v1": pack(np.array([(n[words] > 0).sum()]))}]
        at = 0
        for block, k in zip(pdf["block"], keys):
            part = where[at:at + len(k)]
            out.append({"block": block, "shard": shard, "v0": pack(ids[part].astype(np.uint32)), "v1": pack(n[part])})
            at += len(k)
        del keys, every, where, n, ids
        release_memory()
        return pd.DataFrame(out)

    sent = blocks.select("block", "ids", "held", "lengths", "codes", "keys").mapInPandas(send, "shard int, block long, keys binary, n binary")
    return written(sent.groupBy("shard").applyInPandas(merge, "block long, shard int, v0 binary, v1 binary"), "word_answers")


def look_up_pairs(known: DataFrame, shards: int, word_shards: int) -> DataFrame:
    """block, shard, v0: the trie's codes for the distinct pairs of each block."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                b = Block(row)
                ids, n = _answers(row, "words", [np.uint32, np.int64], (mixed(b.keys) % _U(word_shards)).astype(int))
                ids = ids.astype(_U)
                pairs, where = b.pairs(ids)
                seen = np.bincount(where[b.train], minlength=len(pairs)).astype(np.uint32)
                order = np.argsort(ids)
                of = n[order[np.searchsorted(ids[order], pairs >> _U(32))]]
                context = np.round(np.log10(of + MASS) / STEP).astype(np.uint8)
                for s, at in _by_shard((mixed(pairs) % _U(shards)).astype(np.int32), shards):
                    yield pd.DataFrame({"shard": [s], "block": [row["block"]], "keys": [pack_sorted(pairs[at])], "n": [pack(seen[at])], "context": [pack(context[at])]})
                del b, ids, n, pairs, where, seen, of, context
                release_memory()

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack_sorted(x) for x in pdf["keys"]]
        every, where = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(where, np.concatenate([unpack(x, np.uint32) for x in pdf["n"]]), len(every))
        context = np.zeros(len(every))
        context[where] = np.concatenate([unpack(x, np.uint8) for x in pdf["context"]])
        stored, low = n > 0, _U(2**32 - 1)
        codes = np.clip(np.round(context[stored] - np.log10(n[stored]) / STEP), 0, MISS - 1)
        trie = Trie(Trie.build(every[stored] >> _U(32), every[stored] & low, codes))
        found = trie.find(every >> _U(32), every & low)  # once for all blocks: work grows with the keys alone
        ends = np.cumsum([len(k) for k in keys])
        out = pd.DataFrame({"block": pdf["block"], "shard": pdf["shard"], "v0": [pack(found[w]) for w in np.split(where, ends[:-1])]})
        del keys, every, where, n, context, trie, found
        release_memory()
        return out

    sent = known.mapInPandas(send, "shard int, block long, keys binary, n binary, context binary")
    return written(sent.groupBy("shard").applyInPandas(answer, "block long, shard int, v0 binary"), "pair_answers")


def score(docs: DataFrame, held: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score
    for every row of ``docs``; texts where ``held`` is true are not counted."""
    spark = docs.sparkSession
    table = f"llm_blocks_{uuid.uuid4().hex}"
    made = text_blocks(docs, held)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a table in buckets below the shared folder: later joins leave the blocks in place; its catalog entry is not needed afterwards
    made.write.bucketBy(parts, "block").format("parquet").option("path", scratch(spark, "blocks")).saveAsTable(table)
    blocks = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    total = blocks.agg(F.coalesce(F.sum("n_keys"), F.lit(0)), F.count(F.lit(1))).first()
    word_shards = max(12, -(-total[0] // SHARD_KEYS))
    words = count_words(blocks, word_shards)
    stats = [r for r in words.where("block = -1").select("v0", "v1").collect()]  # two numbers per shard
    n_all = sum(int(unpack(r[0], np.int64)[0]) for r in stats)
    n_words = sum(int(unpack(r[1], np.int64)[0]) for r in stats)
    known = _with_answers(blocks, words.where("block >= 0"), "words", 2)
    pair_shards = max(12, -(-total[1] * BLOCK_TOKENS // SHARD_KEYS))
    codes = look_up_pairs(known, pair_shards, word_shards)
    full = _with_answers(known, codes, "pairs", 1)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                b = Block(row)
                ids, n = _answers(row, "words", [np.uint32, np.int64], (mixed(b.keys) % _U(word_shards)).astype(int))
                pairs, where = b.pairs(ids.astype(_U))
                (code,) = _answers(row, "pairs", [np.uint8], (mixed(pairs) % _U(pair_shards)).astype(np.int32))
                first = np.cumsum(b.lengths) - b.lengths
                own = n[b.codes]
                p = (own + 1) / (n_all + n_words + 1)
                before = np.r_[0, own[:-1]]
                before[first] = n[b.start]
                code = code[where]
                both = np.where(code == MISS, 0.0, 10.0 ** (-STEP * code)) + MASS / (before + MASS) * p
                yield pd.DataFrame({"doc_id": pd.array(list(b.ids), "Int64"), "held_out": b.held == 1, "n_tokens": b.lengths.astype(np.int64),
                                    "n_known": np.add.reduceat((own > 0).astype(np.int64), first), "train_tokens": n_all,
                                    "base_score": np.add.reduceat(np.log10(p), first), "score": np.add.reduceat(np.log10(np.minimum(both, 1.0)), first)})
                del b, ids, n, pairs, where, code, own, p, before, both
                release_memory()

    return full.mapInPandas(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
