"""Ranked lexical search against brute force: nulls, repeated rows, ties, blocks of
few documents, an unfiltered index, and the early stop."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from biasframe.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, k=10):
    tf = [Counter(terms(t)) for _, t in docs]
    n = [sum(c.values()) for c in tf]
    N, L = sum(x > 0 for x in n), sum(n)
    df = Counter(w for c in tf for w in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, own in asked.items():
        rows = []
        for (d, _), c, size in zip(docs, tf, n):
            m = 10 + 90 * size * N // max(L, 1)
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in own if w in c)
            if s > 0:
                rows.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(rows, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(12)
    vocab = [f"w{i}" for i in range(60)] + ["Éa", "世界", "don't", "A1"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    docs = [(i, " ".join(rnd.choices(vocab, weights, k=rnd.randint(1, 40)))) for i in range(300)]
    docs += [(i, docs[5][1]) for i in range(300, 330)] + [(7, "w1 w2"), (7, "w1 w2"), (None, "w50 w51 w52"), (None, "w50"), (900, None), (901, ""), (902, " .,; "), (903, "w3 " * 30000)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(1, 12)))) for i in range(25)] + [(30, None), (31, ""), (32, "unseen"), (33, docs[5][1]), (33, "w9"), (None, "w1 W2")]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(*d, "s", 1) for d in docs], "doc_id long, text string, score string, rank int").repartition(3),
            spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, term int"))


@pytest.mark.parametrize("filtered, block", [(True, 16384), (True, 40), (False, 40)])
def test_equals_brute_force(spark, data, filtered, block, monkeypatch):
    if not filtered:
        monkeypatch.setattr(lexical, "FILTER_TERMS", 3)
    monkeypatch.setattr(lexical, "CHUNK_TERMS", 20)
    got = lexical.search(*frames(spark, *data), 10, block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(*data)


def test_empty_tables(spark, data):
    docs, items = frames(spark, *data)
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs.where("doc_id >= 900 and doc_id < 903"), items).count() == 0


def test_lists_stop_before_their_end():
    n, rnd = 4000, np.random.RandomState(3)
    tf = rnd.randint(1, 4, size=(2, n))
    tf[:, :20] = 500
    args = (np.arange(n).tobytes(), np.zeros(n, np.uint8).tobytes(), np.full(n, 600).tobytes(), ["a", "b"], np.array([n, n]),
            np.tile(np.arange(n, dtype=np.int32), 2).tobytes(), tf.astype(np.int32).tobytes(), n, 600 * n)
    at, score, depth = lexical.Lists(*args).top(["a", "b"], [5, 7], 10)
    assert at.tolist() == list(range(10)) and len(set(score.tolist())) == 1  # ties by document
    assert depth < n / 8
