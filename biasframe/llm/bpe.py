"""Byte-level BPE with a minimal acyclic transducer lexicon (operator 6).

Frequent words are counted over the whole corpus and compiled, with their ids
as outputs, into a minimal acyclic automaton: states with equal suffix sets are
shared, and the word's rank, summed along the path, selects its ids. The
automaton is a flat byte block that every task memory-maps. Words outside the
lexicon are merged exactly, so the lexicon size changes only the speed.

Defined cases: null text counts as empty; an empty text has no ids; the
string of the special token is encoded as that token, as the tokenizer
files say; texts of any length are processed whole; an empty table gives an
empty result; repeated rows give repeated results; a column whose name clashes
with an output is replaced.
"""

from __future__ import annotations

import array
import hashlib
import heapq
import json
import mmap
import re
import struct
import tempfile
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biasframe.llm.common import append_columns, release_memory

#: Fixed value: the pre-tokenizer pattern of the byte-level tokenizer files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

LEXICON_WORDS = 16384
MEMO_WORDS = 300_000
SLICE_CHARS = 1_500_000
LONG_WORD = 48
EMPTY, NONE, HASH = np.uint64(2**64 - 1), 2**62, np.uint64(0x9E3779B97F4A7C15)
#: A text that has other white space than a single space or newline between two chunks.
ODD = (r"[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
       r"|[ \n][ \n]|\A[ \n]|[ \n]\z")
START, HEADS = "\r", "\n\r"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches ``flat[start:start + size]`` one after the other."""
    return flat[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


class Merger:
    """The tokenizer's vocabulary and its exact merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.byte_id = [vocab[c] for c in letters]
        self.pieces = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.pieces.update({i: t.encode() for t, i in self.special.items()})
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(vocab[a] << 32 | vocab[b], r)
            self.made.append(vocab[a + b])
        self.made_ids = np.asarray(self.made, np.uint64)
        slots = 1 << max(4, (4 * len(self.rank)).bit_length())
        self.table_key, self.table_rank = np.full(slots, EMPTY, np.uint64), np.zeros(slots, np.int64)
        self.shift = np.uint64(64 - slots.bit_length() + 1)
        keys = np.fromiter(self.rank.keys(), np.uint64, len(self.rank))
        for at, k, r in zip(((keys * HASH) >> self.shift).tolist(), keys.tolist(), self.rank.values()):
            while self.table_key[at] != EMPTY:
                at = (at + 1) % slots
            self.table_key[at], self.table_rank[at] = k, r

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Exact merges of one word."""
        return self.merge_all([word])[0]

    def _ranks(self, key: np.ndarray) -> np.ndarray:
        """Ranks of adjacent pairs by an open-addressed table."""
        at = (key * HASH) >> self.shift
        out = np.full(len(key), NONE, np.int64)
        left = np.arange(len(key))
        while len(left):
            there = self.table_key[at]
            hit = there == key[left]
            out[left[hit]] = self.table_rank[at[hit]]
            on = ~hit & (there != EMPTY)
            left, at = left[on], (at[on] + np.uint64(1)) & np.uint64(len(self.table_key) - 1)
        return out

    def merge_all(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Exact merges of many words at once."""
        flat, size = self.merge_flat(words)
        ids, end = flat.tolist(), np.cumsum(size).tolist()
        return [tuple(ids[e - n:e]) for e, n in zip(end, size.tolist())]

    def merge_flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and the number of ids of each word.
        Each step merges, in every word, all places of its pair of lowest rank.
        Long words go by a heap."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        flat, count, whose = [], [], []
        for i in np.flatnonzero(length > LONG_WORD).tolist():
            ids = self._merge_long([self.byte_id[b] for b in words[i]])
            flat.append(np.asarray(ids, np.int32))
            count.append([len(ids)])
            whose.append([i])
        word = np.flatnonzero((length > 0) & (length <= LONG_WORD))
        size = length[word]
        sym = np.asarray(self.byte_id, np.uint64)[np.frombuffer(b"".join(map(words.__getitem__, word.tolist())), np.uint8)]
        while len(word):
            start = np.cumsum(size) - size
            owner = np.repeat(np.arange(len(word)), size)
            rank = np.full(len(sym), NONE, np.int64)
            inner = np.flatnonzero(owner[:-1] == owner[1:])
            rank[inner] = self._ranks(sym[inner] << np.uint64(32) | sym[inner + 1])
            low = np.minimum.reduceat(rank, start)
            done = low == NONE
            if done.any():
                keep = ~done[owner]
                flat.append(sym[~keep].astype(np.int32))
                count.append(size[done])
                whose.append(word[done])
                sym, rank, owner, low, word = sym[keep], rank[keep], (np.cumsum(~done) - 1)[owner[keep]], low[~done], word[~done]
                if not len(word):
                    break
            best = rank == low[owner]
            place = np.arange(len(sym))
            run = np.maximum.accumulate(np.where(best & ~np.r_[False, best[:-1]], place, 0))
            best &= (place - run) % 2 == 0  # of overlapping places the left ones
            sym[best] = self.made_ids[rank[best]]
            stay = ~np.r_[False, best[:-1]]
            sym, size = sym[stay], np.bincount(owner[stay], minlength=len(word))
        sizes, starts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        if flat:
            n, at = np.concatenate(count).astype(np.int64), np.concatenate(whose).astype(np.int64)
            sizes[at], starts[at] = n, np.cumsum(n) - n
        return gather(np.concatenate(flat) if flat else np.zeros(0, np.int32), starts, sizes), sizes

    def _merge_long(self, parts: list[int]) -> tuple[int, ...]:
        """The same merges by a heap and a linked list, for words of any length."""
        n, get = len(parts), self.rank.get
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = self.made[r], False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if 0 <= x and y < n and (s := get(parts[x] << 32 | parts[y])) is not None:
                    heapq.heappush(heap, (s, x, parts[x], parts[y]))
        return tuple(p for p, ok in zip(parts, alive) if ok)


def compile_lexicon(entries: dict[bytes, tuple[int, ...]]) -> bytes:
    """A minimal acyclic automaton over the sorted words as one flat block.

    States are registered bottom-up by (final, edges), so equal suffixes are
    stored once. Each edge carries the number of words that sort before it in
    its state; their sum along a path is the rank of the word."""
    words = sorted(entries)
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    register: dict[tuple, int] = {}

    def store(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]
    prefix = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            done = store(path.pop())
            path[-1][1].append((prefix[len(path) - 1], done))

    for w in words:
        same = 0
        while same < min(len(w), len(prefix)) and w[same] == prefix[same]:
            same += 1
        close(same)
        prefix = w
        path.extend([False, []] for _ in w[same:])
        path[-1][0] = True
    close(0)
    root = store(path[0])
    below = []
    for final, edges in states:  # children are stored before their parents
        below.append(int(final) + sum(below[t] for _, t in edges))
    first, label, target, skip = [], [], [], []
    for final, edges in states:
        first.append(len(label))
        passed = int(final)
        for c, t in edges:
            label.append(c)
            target.append(t)
            skip.append(passed)
            passed += below[t]
    first.append(len(label))
    ids, at = [], [0]
    for w in words:
        ids.extend(entries[w])
        at.append(len(ids))
    blocks = [first, [int(f) for f, _ in states], label, target, skip, at, ids]
    head = struct.pack(f"<{2 + len(blocks)}i", root, len(blocks), *[len(x) for x in blocks])
    return head + b"".join(array.array("i", x).tobytes() for x in blocks)


class Lexicon:
    """A compiled lexicon, memory-mapped from an unnamed file of the task."""

    def __init__(self, block: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(block)
            f.flush()
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.root, n = struct.unpack_from("<2i", self._map, 0)
        lengths, at, parts = struct.unpack_from(f"<{n}i", self._map, 8), 8 + 4 * n, []
        for size in lengths:
            parts.append(np.frombuffer(self._map, np.int32, size, at))
            at += 4 * size
        self.first, self.final, self.label, self.target, self.skip, self.at, self.ids = parts
        self.edge = np.repeat(np.arange(len(self.final)), np.diff(self.first)) << 8 | self.label  # ascending

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word in the lexicon, -1 for others: all words walk
        the automaton together, one byte at a step."""
        out = np.full(len(words), -1, np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        at = np.cumsum(size) - size
        word, state, rank = np.arange(len(words)), np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        step = 0
        while len(word):
            ended = size[word] == step
            here = ended & (self.final[state] == 1)
            out[word[here]] = rank[here]
            word, state, rank = word[~ended], state[~ended], rank[~ended]
            key = state << 8 | text[at[word] + step]
            e = np.searchsorted(self.edge, key)
            on = e < len(self.edge)
            on[on] = self.edge[e[on]] == key[on]
            word, state, rank = word[on], self.target[e[on]].astype(np.int64), rank[on] + self.skip[e[on]]
            step += 1
        return out

    def find(self, word: bytes) -> tuple[int, ...] | None:
        rank = int(self.ranks([word])[0])
        return None if rank < 0 else tuple(self.ids[self.at[rank]:self.at[rank + 1]].tolist())


@lru_cache(maxsize=1)
def tables(path: str, block: bytes) -> tuple[Merger, Lexicon]:
    """The fixed tables, kept by a worker process for all tasks it runs."""
    return Merger(path), Lexicon(block)


class Codec:
    """Encoder and decoder of one task.

    A unit is a chunk without white space together with the space, the newline
    or the text start before it. Where no two white-space characters are
    adjacent, units are split and merged without regard to the rest. So a batch
    is cut into units and each distinct one is looked up once: in a bounded
    memo, then in the lexicon; the others are split by the pattern and merged
    exactly. Other texts are split by the pattern as a whole, and their words
    looked up likewise. Ids of all units known stand in one flat array."""

    def __init__(self, path: str, block: bytes):
        self.merger, self.lexicon = tables(path, block)
        self.pieces = [self.merger.pieces.get(i, b"") for i in range(max(self.merger.pieces) + 1)]
        self.words = regex.compile(SPLIT).findall
        special = "|".join(map(regex.escape, self.merger.special))
        self.marks = regex.compile(f"({special})") if special else None
        self.odd = ODD + "".join("|" + re.escape(m) for m in self.merger.special)
        self._forget()

    def _forget(self) -> None:
        """Empty the memo. A unit's key is its chunk, after a newline or START
        where one of these stands before it; a word's key is the word; a special
        token's key has a tab before it, which no word has."""
        self.units: dict[str, int] = {START: 0}
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.size, self.rows = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 1
        for mark, i in self.merger.special.items():
            self.known["\t" + mark] = self._add(np.array([i], np.int32), np.array([1]))

    def _add(self, flat: np.ndarray, size: np.ndarray) -> int:
        """Append the ids of some units; the number of the first one."""
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.rows + len(size) > len(self.size):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        row, rows = self.rows, slice(self.rows, self.rows + len(size))
        self.flat[self.used:self.used + len(flat)] = flat
        self.start[rows], self.size[rows] = self.used + np.cumsum(size) - size, size
        self.used, self.rows = self.used + len(flat), rows.stop
        return row

    def _word_rows(self, words: pa.Array) -> np.ndarray:
        """The row of each word; new words are merged."""
        codes, distinct = coded(words)
        new = [w for w in distinct if w not in self.known]
        row = self._add(*self.merger.merge_flat([w.encode() for w in new]))
        self.known.update(zip(new, range(row, row + len(new))))
        return np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[codes]

    def _unit_rows(self, chunks: pa.Array) -> np.ndarray:
        """The row of each unit; new ones are found in the lexicon or merged."""
        codes, distinct = coded(chunks)
        new = [c for c in distinct if c not in self.units]
        if new:
            full = [c if c[0] in HEADS else " " + c for c in new]
            rank = self.lexicon.ranks([c.encode() for c in full])
            hit = np.flatnonzero(rank >= 0)
            first, last = self.lexicon.at[rank[hit]].astype(np.int64), self.lexicon.at[rank[hit] + 1]
            row = self._add(gather(self.lexicon.ids, first, last - first), last - first)
            self.units.update(zip(map(new.__getitem__, hit.tolist()), range(row, row + len(hit))))
            miss = np.flatnonzero(rank < 0).tolist()
            words = self.words("".join(map(full.__getitem__, miss)))  # only a unit's first word has white space
            opens = np.flatnonzero(np.fromiter((w[0] in HEADS or w[0] == " " for w in words), bool, len(words)))
            rows = self._word_rows(pa.array([w for w in words], pa.string()))
            size = self.size[rows]
            size[np.fromiter((w == START for w in words), bool, len(words))] = 0
            total = np.add.reduceat(size, opens) if len(opens) else size
            row = self._add(gather(self.flat, self.start[rows], size), total)
            self.units.update(zip(map(new.__getitem__, miss), range(row, row + len(miss))))
        return np.fromiter(map(self.units.__getitem__, distinct), np.int64, len(distinct))[codes]

    def _ids(self, rows: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """The ids of texts whose units are ``rows``, each ending at ``ends``."""
        size = self.size[rows]
        cuts = np.r_[0, np.cumsum(size)][ends]
        return np.split(gather(self.flat, self.start[rows], size), cuts[:-1])

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.units) + len(self.known) > MEMO_WORDS:
            self._forget()
        every = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(every, self.odd).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        plain = np.flatnonzero(~odd)
        if len(plain):
            marked = pc.replace_substring(every.take(pa.array(plain)), "\n", " \n")
            cut = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(START, pa.large_string()), marked, pa.scalar("", pa.large_string())), " ")
            ends = np.cumsum(pc.list_value_length(cut).to_numpy())
            for i, ids in zip(plain.tolist(), self._ids(self._unit_rows(cut.flatten()), ends)):
                out[i] = ids
        if odd.any():
            words, ends = [], []
            for i in np.flatnonzero(odd).tolist():
                for k, part in enumerate(self.marks.split(texts[i]) if self.marks else [texts[i]]):
                    words += ["\t" + part] if k % 2 else self.words(part)
                ends.append(len(words))
            for i, ids in zip(np.flatnonzero(odd).tolist(), self._ids(self._word_rows(pa.array(words, pa.large_string())), np.array(ends))):
                out[i] = ids
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


def coded(values: pa.Array) -> tuple[np.ndarray, list[str]]:
    """The number of each value among the distinct ones, and these."""
    found = values.dictionary_encode()
    return found.indices.to_numpy(), found.dictionary.to_pylist()


def slices(texts: list[str]) -> Iterator[list[str]]:
    """Stretches of a batch of about SLICE_CHARS, a longer text alone or last."""
    some, chars = [], 0
    for t in texts:
        some.append(t)
        chars += len(t)
        if chars >= SLICE_CHARS:
            yield some
            some, chars = [], 0
    if some:
        yield some


def frequent_words(docs: DataFrame, text_col: str = "text", limit: int = LEXICON_WORDS) -> list[str]:
    """The words to compile: every task counts all white-space words of its rows
    and sends its ``limit`` most frequent ones; the sums give the ``limit`` most frequent
    of the corpus. Only the speed depends on this list."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                words = pc.utf8_split_whitespace(b.column(0).slice(at, 1000).drop_null()).flatten().value_counts()
                for w, n in zip(words.field("values").to_pylist(), words.field("counts").to_pylist()):
                    seen[w] += n
            if len(seen) > 10 * limit:  # bounded memory: the rare ones give way
                seen = Counter(dict(seen.most_common(4 * limit)))
        top = [(w, n) for w, n in seen.most_common(limit) if 0 < len(w) <= 64]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])
        del seen, top
        release_memory()

    counts = docs.select(text_col).mapInArrow(count, "word string, n long")
    best = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(limit)
    return [r.word for r in best.collect()]


def lexicon_block(docs: DataFrame, path: str, text_col: str = "text", limit: int = LEXICON_WORDS) -> bytes:
    """The compiled lexicon of a corpus; at most ``limit`` words, each of at
    most 64 characters, so its size is bounded whatever the corpus."""
    merger = Merger(path)
    split, entries = regex.compile(SPLIT).findall, {}
    for w in frequent_words(docs, text_col, limit):
        entries[f" {w}".encode()] = tuple(chain.from_iterable(merger.merge_all([x.encode() for x in split(f" {w}")])))
    return compile_lexicon(entries)


def encode_decode(docs: DataFrame, path: str, text_col: str = "text", limit: int = LEXICON_WORDS,
                  digests: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids`` and ``decoded``; with ``digests``,
    ``ids_sha256`` (of the decimal ids, comma-joined) and ``decoded_sha256``
    take the place of the last two. One pass, no shuffle of texts."""
    block = docs.sparkSession.sparkContext.broadcast(lexicon_block(docs, path, text_col, limit))

    def make():
        codec = Codec(path, block.value)
        name = [str(i) for i in range(len(codec.pieces))]

        def run(texts: list[str | None]) -> tuple:
            ids, back = [], []
            for part in slices([t or "" for t in texts]):  # bounded memory within a batch
                for found in codec.encode_all(part):
                    x = found.tolist()
                    if digests:
                        ids.append((len(x), hashlib.sha256(",".join(map(name.__getitem__, x)).encode()).hexdigest()))
                        back.append(hashlib.sha256(codec.decode(x).encode()).hexdigest())
                    else:
                        ids.append((len(x), found))
                        back.append(codec.decode(x))
            return [n for n, _ in ids], [x for _, x in ids], back

        return run

    L, S = T.LongType(), T.StringType()
    fields = [("n_tokens", L), *([("ids_sha256", S), ("decoded_sha256", S)] if digests else [("ids", T.ArrayType(T.IntegerType())), ("decoded", S)])]
    return append_columns(docs, [text_col], [T.StructField(n, t) for n, t in fields], make)
