"""Quality classifier (operator 1): a generalised additive model with pairwise
interactions. Shallow trees are boosted cyclically, one feature (then one pair)
at a time, and summed into one lookup table per feature and pair; scoring is a
vectorised sum of table entries at the bins of a row.

Training uses a sample of at most ``max_rows`` labelled rows (a documented
parameter; chosen by a hash of the id over all labelled rows). Scoring reads
every whole text once, without a shuffle.

Defined cases: null text counts as empty; an empty text has the features 0 and
gets their score; with no labelled row every score is 0.5; rows without a label
are scored like others; clashing column names are replaced; repeated labels of
an id count once, by their largest value.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biasframe.llm.common import append_columns

FEATURES = ("log_words", "word_length", "distinct_words", "repeated_next", "upper", "digit", "symbol",
            "punctuation", "non_ascii", "log_line_words", "repeated_lines", "common_byte_share", "marked_words")

_CLASS = np.zeros((6, 256))
_CLASS[0, 65:91] = 1
_CLASS[1, 48:58] = 1
_CLASS[2, [ord(c) for c in "#*$%&|<>@^~=+_\\{}[]"]] = 1
_CLASS[3, [ord(c) for c in ".,;:!?'\"()-"]] = 1
_CLASS[4, 128:] = 1
_CLASS[5, [ord(c) for c in " \t\n\x0b\x0c\r"]] = 1
_MARKS = frozenset(b"#*$%&|<>!")


def text_features(text: str | None) -> list[float]:
    """Statistics of one whole text, none of them from metadata."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    upper, digit, symbol, punct, other, gap = _CLASS @ seen
    chars, n = len(raw) - gap, len(words)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    letters = np.sort(seen[33:])[::-1]
    return [np.log1p(n), chars / n, len(set(words)) / n, sum(map(eq, words, words[1:])) / n, upper / chars, digit / chars,
            symbol / chars, punct / chars, other / chars, np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines),
            letters[:5].sum() / chars, sum(w[-1] in _MARKS for w in words) / n]


def feature_block(texts: list[str | None]) -> np.ndarray:
    return np.array([text_features(t) for t in texts], float).reshape(len(texts), len(FEATURES))


@dataclass
class AdditiveModel:
    """Lookup tables over the bins of features and of pairs of features."""

    cuts: list[np.ndarray]
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)  # bin -> coarse bin
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], 1) if len(x) else np.zeros(x.shape, int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            z += t[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, depth: int, l2: float) -> np.ndarray:
    """Leaf value per bin of a tree of ``depth`` over one ordered feature."""
    out = np.full(len(g), g.sum() / (h.sum() + l2))
    if depth == 0 or len(g) < 2:
        return out
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + l2) + gr**2 / (hr + l2)
    at = int(np.argmax(gain)) + 1
    return np.r_[_tree(g[:at], h[:at], depth - 1, l2), _tree(g[at:], h[at:], depth - 1, l2)]


def _quadrants(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[np.ndarray, float]:
    """The best tree with one cut on each of two features, and its gain."""
    gs, hs = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)

    def parts(s: np.ndarray) -> list[np.ndarray]:
        a, row, col, all_ = s[:-1, :-1], s[:-1, -1:], s[-1:, :-1], s[-1, -1]
        return [a, row - a, col - a, all_ - row - col + a]

    pg, ph = parts(gs), parts(hs)
    gain = sum(x**2 / (y + l2) for x, y in zip(pg, ph))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    leaf = [x[i, j] / (y[i, j] + l2) for x, y in zip(pg, ph)]
    out = np.empty_like(g)
    out[:i + 1, :j + 1], out[:i + 1, j + 1:], out[i + 1:, :j + 1], out[i + 1:, j + 1:] = leaf
    return out, float(gain[i, j] - gs[-1, -1]**2 / (hs[-1, -1] + l2))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.2, n_bins: int = 32, n_coarse: int = 8,
        n_pairs: int = 6, l2: float = 4.0) -> AdditiveModel:
    """Cyclic boosting: every round gives each feature one shallow tree fitted
    to the current gradients; then the pairs with the largest gain follow."""
    if not len(y):
        return AdditiveModel([np.array([])] * x.shape[1])
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) for j in range(x.shape[1])]
    m = AdditiveModel(cuts, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    b = m.bins(x)
    sizes = [len(c) + 1 for c in cuts]
    m.tables = [np.zeros(s) for s in sizes]
    m.coarse = [(np.arange(s) * n_coarse // s).astype(int) for s in sizes]
    z = np.full(len(y), m.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, s in enumerate(sizes):
            g, h = slopes()
            t = rate * _tree(np.bincount(b[:, j], g, s), np.bincount(b[:, j], h, s), 2, l2)
            m.tables[j] += t
            z += t[b[:, j]]
    cb = [m.coarse[j][b[:, j]] for j in range(len(sizes))]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(cb[i] * n_coarse + cb[j], v, n_coarse * n_coarse).reshape(n_coarse, n_coarse)

    g, h = slopes()
    gains = [(_quadrants(grid(i, j, g), grid(i, j, h), l2)[1], i, j) for i in range(len(sizes)) for j in range(i)]
    m.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:n_pairs]]
    m.pair_tables = [np.zeros((n_coarse, n_coarse)) for _ in m.pairs]
    for _ in range(rounds // 2):
        for (i, j), table in zip(m.pairs, m.pair_tables):
            g, h = slopes()
            t = rate * _quadrants(grid(i, j, g), grid(i, j, h), l2)[0]
            table += t
            z += t[cb[i], cb[j]]
    return m


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> AdditiveModel:
    """Fit on at most ``max_rows`` labelled rows. The sample is a hash range of
    the labelled ids, so it is taken from all of them; it alone is broadcast,
    and only its rows leave the text scan, as one short vector each."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("_y"))
    count = labels.where(F.col(label_col).isNotNull()).count()
    share = min(1.0, 1.1 * max_rows / max(count, 1))
    mixed = F.xxhash64(F.lit(17), F.col(id_col))
    sample = known.where(F.pmod(mixed, F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(mixed, id_col).limit(max_rows)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_t")).join(F.broadcast(sample), id_col)
    fields = [T.StructField("_x", T.ArrayType(T.DoubleType()))]
    made = append_columns(rows, ["_t"], fields, lambda: lambda texts: [feature_block(texts).tolist()]).select("_x", "_y", id_col)
    got = made.orderBy(F.xxhash64(F.lit(17), F.col(id_col)), id_col).limit(max_rows).collect()
    return fit(np.array([r[0] for r in got], float).reshape(len(got), len(FEATURES)), np.array([r[1] for r in got], float))


def score(docs: DataFrame, model: AdditiveModel, threshold: float = 0.7, text_col: str = "text",
          outputs: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 if the score reaches
    ``threshold``), or these two under other names. The broadcast model is a few
    lookup tables of fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def run(texts: list[str | None]) -> Iterator:
            p = m.score(feature_block(texts))
            return [p, (p >= threshold).astype(np.int32)]

        return run

    return append_columns(docs, [text_col], [T.StructField(outputs[0], T.DoubleType()), T.StructField(outputs[1], T.IntegerType())], make)
