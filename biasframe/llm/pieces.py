"""SentencePiece encoding by backtracking (operator 11).

A sentence-piece model of merge type joins, again and again, the two adjacent
symbols whose join is the best piece (of equal ones the leftmost). Nothing of
that order is replayed over a text here. A sequence of pieces is the encoding if
and only if each two neighbours, merged on their own, come out as these two: the
first merge across a boundary would happen likewise in the text of the two
pieces alone. So a text is walked from the left: at each place the longest piece
that starts there is tried, then its shorter prefixes; a piece is taken if it
goes with the one before it (found by merging both anew, kept in a table), and
where none does, the place is marked as failed in a bitfield and the last piece
is taken back. An encoding of a prefix is unique, so one bit a place is enough.
The longest piece that starts at a place comes from one Aho-Corasick pass over
the text backwards, its shorter prefixes from a table. The new units of a batch
take each step together, as arrays; units above ``LONG_UNIT`` go one by one.

No piece holds a space mark behind another character (checked when a model is
read), so a text falls into units, each a run of spaces with the characters up to
the next space; a distinct unit is encoded once for a batch and kept in a
bounded memo. Characters without a piece become their UTF-8 bytes.

Defined cases: null text counts as empty; an empty text has no ids; a written
space mark is a space, as in the library; texts and units of any length are
processed whole; strings of control pieces are ordinary text; an empty table
gives an empty result; repeated rows give repeated results; a column whose name
clashes with an output is replaced. A model without byte pieces, or with a
normaliser beyond the dummy space before the text, raises ValueError.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from biasframe.llm.bpe import coded, gather
from biasframe.llm.common import append_columns

SPACE = "▁"
MEMO_UNITS = 200_000
MEMO_PAIRS = 1 << 20
LONG_UNIT = 63  # places whose bitfield is one 64-bit word
ROOT, ALONE = 0, 0x1FFFFF
EMPTY, FACTOR = np.uint64(2**64 - 1), np.uint64(0x9E3779B97F4A7C15)
HEADS = SPACE + "\n"
#: A text for which normalisation must change nothing but add the dummy space and mark the spaces.
PROBE = " ﬁ ½  Å Ａ\t\n　 b "

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Table:
    """Whole numbers by 64-bit keys, open-addressed; read by arrays of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self._room(len(keys))
        self.add(keys, values)

    def _room(self, n: int) -> None:
        bits = max(10, (3 * n).bit_length())
        self.key, self.value, self.n = np.full(1 << bits, EMPTY, np.uint64), np.zeros(1 << bits, np.int32), 0
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New keys, each once."""
        if 2 * (self.n + len(keys)) > len(self.key):
            old, self_value = self.key != EMPTY, self.value
            more = self.key[old], self_value[old]
            self._room(2 * (len(more[0]) + len(keys)))
            self.add(*more)
        self.n += len(keys)
        left = np.arange(len(keys))
        at = (keys * FACTOR) >> self.shift
        while len(left):  # of the keys that want one free slot the first gets it
            free = np.flatnonzero(self.key[at] == EMPTY)
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.key[at[put]], self.value[at[put]] = keys[left[put]], values[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, at = left[rest], (at[rest] + np.uint64(1)) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 for unknown keys."""
        at = (keys * FACTOR) >> self.shift
        there = self.key[at]
        hit = there == keys
        out = np.where(hit, self.value[at], np.int32(-1))
        left = np.flatnonzero(~hit & (there != EMPTY))
        at = at[left]
        while len(left):
            at = (at + np.uint64(1)) & self.mask
            there = self.key[at]
            hit = there == keys[left]
            out[left[hit]] = self.value[at[hit]]
            on = ~hit & (there != EMPTY)
            left, at = left[on], at[on]
        return out


class Automaton:
    """Aho-Corasick automaton of words; every state knows its longest word."""

    def __init__(self, words: dict[str, int]):
        step: list[dict[str, int]] = [{}]
        self.out = [-1]
        for w, i in words.items():
            at = ROOT
            for c in w:
                to = step[at].get(c)
                if to is None:
                    to = step[at][c] = len(step)
                    step.append({})
                    self.out.append(-1)
                at = to
            self.out[at] = i
        fail, queue = [ROOT] * len(step), list(step[ROOT].values())
        for at in queue:  # by depth
            for c, to in step[at].items():
                back = fail[at]
                while back and c not in step[back]:
                    back = fail[back]
                fail[to] = step[back].get(c, ROOT)
                if self.out[to] < 0:
                    self.out[to] = self.out[fail[to]]
                queue.append(to)
        self.step, self.fail, self.longest = step, np.array(fail, np.int64), np.array(self.out, np.int64)
        edges = [(at << 21 | ord(c), to) for at, d in enumerate(step) for c, to in d.items()]
        self.edges = Table(np.array([k for k, _ in edges], np.uint64), np.array([to for _, to in edges], np.int32))

    def run(self, text: str) -> list[int]:
        """The longest word that ends at each place, -1 where none does."""
        step, fail, out, at, found = self.step, self.fail, self.out, ROOT, []
        for c in text:
            while at and c not in step[at]:
                at = int(fail[at])
            at = step[at].get(c, ROOT)
            found.append(out[at])
        return found

    def move(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The next state of many runs."""
        to = self.edges.get((state << 21 | letter).astype(np.uint64)).astype(np.int64)
        left = np.flatnonzero((to < 0) & (state != ROOT))
        back = state[left]
        while len(left):
            back = self.fail[back]
            found = self.edges.get((back << 21 | letter[left]).astype(np.uint64))
            to[left] = found
            on = (found < 0) & (back != ROOT)
            left, back = left[on], back[on]
        to[to < 0] = ROOT
        return to


class Model:
    """The pieces of a model file, their scores and the automaton of the pieces
    spelt backwards. Behind the pieces, every character has a number too, for
    characters that are no piece."""

    def __init__(self, path: str):
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        if lib.normalize(PROBE) != (SPACE + PROBE).replace(" ", SPACE):
            raise ValueError("the model's normaliser does more than to add a space before the text")
        n = self.n = lib.get_piece_size()
        self.text = [lib.id_to_piece(i) for i in range(n)]
        silent = [lib.is_control(i) for i in range(n)]
        byte = [lib.is_byte(i) for i in range(n)]
        byte_id = {int(self.text[i][3:5], 16): i for i in range(n) if byte[i]}
        if len(byte_id) < 256 or n + 0x110000 >= ALONE:
            raise ValueError("the model has no byte pieces, or too many pieces")
        self.byte_id = np.array([byte_id[b] for b in range(256)], np.int64)
        plain = [i for i in range(n) if not (byte[i] or silent[i] or lib.is_unknown(i) or lib.is_unused(i))]
        if any(re.search(f"[^{SPACE}]{SPACE}", self.text[i]) for i in plain):
            raise ValueError("a piece holds a space behind another character")
        self.score = {self.text[i]: lib.get_score(i) for i in plain}
        self.id = {self.text[i]: i for i in plain}
        self.letters = {c for t in self.id for c in t}
        self.size, self.shorter = np.ones(n + 0x110000, np.int64), np.full(n + 0x110000, -1, np.int64)
        for t, i in self.id.items():
            self.size[i] = len(t)
            self.shorter[i] = next((self.id[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.id), -1)
            if self.shorter[i] < 0 and len(t) > 1:  # the first character is no piece: it alone is what is left
                self.shorter[i] = n + ord(t[0])
        self.back = Automaton({t[::-1]: i for t, i in self.id.items()})
        self.spelt = [b"" if silent[i] else bytes([int(t[3:5], 16)]) if byte[i] else t.replace(SPACE, " ").encode() for i, t in enumerate(self.text)]
        self.silent = [i for i in range(n) if silent[i]]
        self.spelt[lib.unk_id()] = " ⁇ ".encode()
        opens = {i for t, i in self.id.items() if t.startswith(SPACE)}
        self.marked = [i in opens for i in range(n)]
        self._forget()

    def _forget(self) -> None:
        self.pairs = Table(np.zeros(0, np.uint64), np.zeros(0, np.int32))

    def merged(self, text: str) -> list[str]:
        """The merges themselves, for texts of one or two pieces."""
        parts, get = list(text), self.score.get
        ranks = [get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, s in enumerate(ranks):
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = get(parts[at - 1] + parts[at])
            if at < len(ranks):
                ranks[at] = get(parts[at] + parts[at + 1])

    def spelling(self, piece: int) -> str:
        return self.text[piece] if piece < self.n else chr(piece - self.n)

    def fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Do adjacent pieces stay as they are when the two are merged anew? With
        ALONE on the left: does the piece come out of its own text?"""
        key = (left << 21 | right).astype(np.uint64)
        found = self.pairs.get(key)
        if (found < 0).any():
            new = np.unique(key[found < 0])
            if self.pairs.n + len(new) > max(MEMO_PAIRS, 2 * len(new)):
                self._forget()
                new = np.unique(key)
            good = []
            for k in new.tolist():
                parts = [self.spelling(i) for i in (k >> 21, k & ALONE) if i != ALONE]
                good.append(self.merged("".join(parts)) == parts)
            self.pairs.add(new, np.array(good, np.int32))
            found = self.pairs.get(key)
        return found == 1

    def pieces_long(self, unit: str) -> list[int]:
        """The encoding of one unit of any length by backtracking."""
        longest = self.back.run(unit[::-1])[::-1]
        failed = bytearray(len(unit) // 8 + 1)
        taken, known, at, last = [], {}, 0, ALONE

        def fits(a: int, b: int) -> bool:
            if (a, b) not in known:
                known[a, b] = bool(self.fit(np.array([a]), np.array([b]))[0])
            return known[a, b]

        piece = self._first(longest, unit, 0)
        while at < len(unit):
            while piece >= 0:
                to = at + int(self.size[piece])
                if not failed[to >> 3] >> (to & 7) & 1 and fits(last, piece):
                    break
                piece = int(self.shorter[piece])
            if piece >= 0:
                taken.append(piece)
                at, last = to, piece
                piece = self._first(longest, unit, at)
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = taken.pop()
                at, last = at - int(self.size[piece]), taken[-1] if taken else ALONE
                piece = int(self.shorter[piece])
        return taken

    def _first(self, longest: list[int], unit: str, at: int) -> int:
        return -1 if at >= len(unit) else longest[at] if longest[at] >= 0 else self.n + ord(unit[at])

    def pieces_short(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The encodings of many units by backtracking, all taking one step at a
        time, one after the other in an array, and their lengths."""
        n = np.fromiter(map(len, units), np.int64, len(units))
        letters = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        first = np.cumsum(n) - n
        longest = np.empty(len(letters), np.int64)
        order = np.argsort(-n, kind="stable")
        state, ends = np.zeros(len(units), np.int64), (first + n - 1)[order]
        many = np.searchsorted(-n[order], -np.arange(1, int(n.max(initial=0)) + 1), side="right")
        for k, m in enumerate(many.tolist()):  # the units with more than k characters, from their ends
            place = ends[:m] - k
            state = self.back.move(state[:m], letters[place])
            longest[place] = self.back.longest[state]
        longest = np.where(longest < 0, self.n + letters, longest)
        stack = np.zeros((len(units), int(n.max(initial=0)) + 1), np.int64)
        stack[:, 0] = ALONE
        depth, who, at = np.zeros(len(units), np.int64), np.arange(len(units)), np.zeros(len(units), np.int64)
        failed, piece, one = np.zeros(len(units), np.uint64), longest[first] if len(units) else first, np.uint64(1)
        while len(who):
            last = stack[who, depth[who]]
            to = at + self.size[piece]
            good = (piece >= 0) & (failed[who] >> to.astype(np.uint64) & one == 0)
            at_good = np.flatnonzero(good)
            good[at_good] = self.fit(last[at_good], piece[at_good])
            yes, no = np.flatnonzero(good), np.flatnonzero(~good)
            depth[who[yes]] += 1
            stack[who[yes], depth[who[yes]]] = piece[yes]
            at[yes] = to[yes]
            following = np.minimum(first[who[yes]] + at[yes], max(len(longest) - 1, 0))
            gone = no[piece[no] < 0]  # nothing left to try at this place
            piece[no] = np.where(piece[no] >= 0, self.shorter[piece[no]], -1)
            piece[yes] = longest[following]
            failed[who[gone]] |= one << at[gone].astype(np.uint64)
            back = stack[who[gone], depth[who[gone]]]
            depth[who[gone]] -= 1
            at[gone] -= self.size[back]
            piece[gone] = self.shorter[back]
            on = at < n[who]
            who, at, piece = who[on], at[on], piece[on]
        taken = np.arange(1, stack.shape[1])[None, :] <= depth[:, None]
        return stack[:, 1:][taken], depth

    def ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units, one after the other, and their numbers."""
        short = [k for k, u in enumerate(units) if len(u) <= LONG_UNIT]
        flat, count = self.pieces_short([units[k] for k in short])
        if len(short) < len(units):
            size, start = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
            size[short], start[short] = count, np.cumsum(count) - count
            more = [flat]
            for k in sorted(set(range(len(units))) - set(short)):
                found = np.array(self.pieces_long(units[k]), np.int64)
                size[k], start[k] = len(found), sum(map(len, more))
                more.append(found)
            flat, count = gather(np.concatenate(more), start, size), size
        bare = np.flatnonzero(flat >= self.n)
        if len(bare):  # characters become their bytes
            letters = (flat[bare] - self.n).astype(np.uint32)
            raw = np.frombuffer(letters.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
            width = np.ones(len(flat), np.int64)
            width[bare] = 1 + (letters >= 0x80) + (letters >= 0x800) + (letters >= 0x10000)
            owner = np.repeat(np.arange(len(count)), count)
            mark = np.repeat(flat >= self.n, width)
            flat = np.repeat(flat, width)
            flat[mark] = self.byte_id[raw]
            count = np.bincount(owner, width, len(count)).astype(np.int64)
        return flat.astype(np.int32), count

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: the dummy space goes, each byte that is no part of
        a character is a replacement character."""
        if any(i in ids for i in self.silent):  # bytes on both sides of such a piece are no character
            cuts = [-1, *(k for k, i in enumerate(ids) if i in self.silent), len(ids)]
            parts = [ids[a + 1:b] for a, b in zip(cuts, cuts[1:])]
        else:
            parts = [ids]
        text = "".join(b"".join(map(self.spelt.__getitem__, part)).decode("utf-8", "each_byte") for part in parts)
        first = next((i for i in ids if self.spelt[i]), None)
        return text[1:] if first is not None and self.marked[first] else text


@lru_cache(maxsize=1)
def model(path: str) -> Model:
    """The fixed tables, kept by a worker process for all tasks it runs."""
    return Model(path)


class Codec:
    """Encoder and decoder of one task with its bounded memo of units. A unit's key
    is its text; a key without a space or newline before it has one space."""

    def __init__(self, path: str):
        self.model = model(path)
        self.plain_newline = "\n" not in self.model.letters
        self.odd = f"\\A |  |{SPACE}" + ("" if self.plain_newline else "|\n")
        self.split = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self._forget()

    def _forget(self) -> None:
        self.row: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _rows(self, units: pa.Array) -> np.ndarray:
        """The number of each unit in the memo; new ones are encoded."""
        codes, distinct = coded(units)
        if len(self.row) + len(distinct) > max(MEMO_UNITS, 2 * len(distinct)):
            self._forget()
        known = self.row
        new = [u for u in distinct if u not in known]
        if new:
            flat, size = self.model.ids([u if u[:1] in HEADS and u else SPACE + u for u in new])
            while self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while len(known) + len(new) > len(self.start):
                self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
            self.flat[self.used:self.used + len(flat)] = flat
            rows = slice(len(known), len(known) + len(new))
            self.start[rows], self.size[rows] = self.used + np.cumsum(size) - size, size
            self.used += len(flat)
            known.update(zip(new, range(rows.start, rows.stop)))
        return np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))[codes]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        every = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(every, self.odd).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        plain = np.flatnonzero(~odd & (pc.binary_length(every).to_numpy() > 0))
        jobs = []
        if len(plain):
            body = every.take(pa.array(plain))
            cut = pc.split_pattern(pc.replace_substring(body, "\n", " \n") if self.plain_newline else body, " ")
            jobs.append((plain, cut.flatten(), pc.list_value_length(cut).to_numpy()))
        others = np.flatnonzero(odd)
        if len(others):
            cut = [[u[1:] if u[:1] == SPACE and u[1:2] not in (SPACE, "\n") else u for u in self.split((" " + texts[i]).replace(" ", SPACE))]
                   for i in others.tolist()]
            jobs.append((others, pa.array([u for c in cut for u in c], pa.large_string()), np.array(list(map(len, cut)))))
        for at, units, count in jobs:
            rows = self._rows(units)
            size = self.size[rows]
            cuts = np.r_[0, np.cumsum(size)][np.cumsum(count)]
            for i, ids in zip(at.tolist(), np.split(gather(self.flat, self.start[rows], size), cuts[:-1])):
                out[i] = ids
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()


def encode_decode(docs: DataFrame, path: str, text_col: str = "text", digests: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids`` and ``decoded``; with ``digests``,
    ``ids_sha256`` (of the decimal ids, comma-joined) and ``decoded_sha256``
    take the place of the last two. One pass, no shuffle."""

    def make():
        codec = Codec(path)
        decode, name = codec.model.decode, [str(i) for i in range(len(codec.model.text))]

        def run(texts: list[str | None]) -> tuple:
            count, ids, back = [], [], []
            for found in codec.encode_all([t or "" for t in texts]):
                x = found.tolist()
                count.append(len(x))
                ids.append(hashlib.sha256(",".join(map(name.__getitem__, x)).encode()).hexdigest() if digests else found)
                back.append(hashlib.sha256(decode(x).encode("utf-8", "surrogatepass")).hexdigest() if digests else decode(x))
            return count, ids, back

        return run

    L, S = T.LongType(), T.StringType()
    fields = [("n_tokens", L), *([("ids_sha256", S), ("decoded_sha256", S)] if digests else [("ids", T.ArrayType(T.IntegerType())), ("decoded", S)])]
    return append_columns(docs, [text_col], [T.StructField(n, t) for n, t in fields], make)
