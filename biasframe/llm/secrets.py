"""Secret scans (operator 3).

One Aho-Corasick pass over the text finds keywords; only where one is found is
the regular expression of its kind tried, anchored at the hit. Kinds with an
embedded checksum are kept only if it is right. Runs of hexadecimal digits have
no keyword: the digits themselves are the anchor.

Defined cases: null text counts as empty; empty texts and tables have no spans;
texts of any length are scanned whole; spans are in code points, end exclusive;
repeated rows give repeated results; clashing column names are replaced.
"""

from __future__ import annotations

import binascii
import hashlib
import re
from typing import NamedTuple

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from biasframe.llm.common import append_columns

# The kinds in report order, their keywords and patterns.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
REPO_TOKEN = r"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])"
PACKAGE_TOKEN = r"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])"
EXTENDED_KEY = r"[xt]prv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])"


def crc_tail(text: str) -> bool:
    """Thirty random letters, then their CRC-32 as six base-62 digits."""
    body, n = text[-36:-6], 0
    for c in text[-6:]:
        n = n * 62 + BASE62.index(c)
    return binascii.crc32(body.encode()) == n


def base58_check(text: str) -> bool:
    """78 bytes and the first four of their double SHA-256, in base 58."""
    n = 0
    for c in text:
        n = n * 58 + BASE58.index(c)
    if n >> (82 * 8):
        return False
    raw = n.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


class Kind(NamedTuple):
    name: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    valid: object


KINDS = (
    Kind("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), re.compile(ASSIGN, re.I | re.A), lambda m: len(m[2]) >= 8),
    Kind("access", ("akia",), re.compile(ACCESS), lambda m: len(m[0]) >= 16),
    Kind("hex", (), re.compile(HEX), lambda m: True),
    Kind("repo_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(REPO_TOKEN), lambda m: crc_tail(m[0])),
    Kind("package_token", ("npm_",), re.compile(PACKAGE_TOKEN), lambda m: crc_tail(m[0])),
    Kind("extended_key", ("xprv", "tprv"), re.compile(EXTENDED_KEY), lambda m: base58_check(m[0])),
)
BASE_KINDS = 3


class Scanner:
    def __init__(self):
        self.words = ahocorasick.Automaton()
        for k, kind in enumerate(KINDS):
            for w in kind.keywords:
                self.words.add_word(w, (k, len(w)))
        self.words.make_automaton()
        self.hex_runs = KINDS[2].pattern.finditer

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of every finding, by start, then kind."""
        found = [(m.start(), 2, m.end()) for m in self.hex_runs(text)]
        folded = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # lowers A-Z only
        past = [0] * len(KINDS)
        for last, (k, size) in self.words.iter(folded):
            start = last + 1 - size
            if start >= past[k] and (m := KINDS[k].pattern.match(text, start)):
                past[k] = m.end()  # matches of a kind do not overlap, kept or not
                if KINDS[k].valid(m):
                    found.append((start, k, m.end()))
        found.sort()
        return found


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``spans``: an array of (kind, start, end, base). No shuffle."""
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                     T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))

    def make():
        scanner = Scanner()
        return lambda texts: [[[{"kind": KINDS[k].name, "start": a, "end": b, "base": k < BASE_KINDS}
                                for a, k, b in scanner.spans(t or "")] for t in texts]]

    return append_columns(docs, [text_col], [T.StructField("spans", kind)], make)


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[secret]", count_col: str | None = None) -> DataFrame:
    """``docs`` with every found span, overlapping ones joined, replaced by
    ``mask``; ``count_col`` (if given) is set to the new length. Texts without
    a finding, nulls among them, stay as they are."""
    fields = [T.StructField(text_col, T.StringType())] + ([T.StructField(count_col, T.LongType())] if count_col else [])

    def make():
        scanner = Scanner()

        def clean(text: str | None) -> str | None:
            out, at = [], 0
            for a, _, b in scanner.spans(text) if text else ():
                if a >= at:
                    out += [text[at:a], mask]
                at = max(at, b)
            return "".join([*out, text[at:]]) if out else text

        def run(texts: list, *counts: list) -> list[list]:
            new = [clean(t) for t in texts]
            return [new] + [[n if a == b or b is None else len(b) for a, b, n in zip(texts, new, counts[0])]] * len(counts)

        return run

    order = docs.columns
    return append_columns(docs, [text_col] + ([count_col] if count_col else []), fields, make).select(*order)
