"""Language-model scores against a model kept in dictionaries."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from biasframe.llm import ngram_lm


def plain(texts, held):
    words = [[w.decode() for w in (t or "").encode().lower().split()] + [" "] for t in texts]
    train = [w for w, h in zip(words, held) if not h]
    one = Counter(x for w in train for x in w)
    context = one + Counter({"\n": len(train)})
    two = Counter(p for w in train for p in zip(["\n"] + w, w))
    n, v = sum(one.values()), len(one)
    out = []
    for w in words:
        total = 0.0
        for a, b in zip(["\n"] + w, w):
            p = (one[b] + 1) / (n + v + 1)
            total += math.log10((two[a, b] + ngram_lm.MASS * p) / (context[a] + ngram_lm.MASS))
        out.append((len(w), total))
    return out


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    made = [" ".join(rnd.choices(vocab, weights, k=rnd.randint(1, 60))) for _ in range(120)]
    return made + made[:10] + [None, "", "Upper CASE words", "q " * 5000, " ".join(f"once{i}" for i in range(60))]


@pytest.mark.parametrize("tokens", [2_000_000, 200])
def test_score_equals_dictionaries(spark, texts, tokens, monkeypatch):
    monkeypatch.setattr(ngram_lm, "BLOCK_TOKENS", tokens)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in ngram_lm.score(docs, F.col("doc_id") % 5 == 2).collect()}
    want = plain(texts, [i % 5 == 2 for i in range(len(texts))])
    assert len(got) == len(texts)
    for i, (n, total) in enumerate(want):
        # two quantised logarithms, each off by half a step at most
        assert got[i].n_tokens == n and abs(got[i].score - total) <= n * ngram_lm.STEP + 1e-9
    assert abs(sum(r.score for r in got.values()) / sum(t for _, t in want) - 1) < 0.005


def test_what_occurs_twice_is_likelier(spark):
    rnd = random.Random(9)
    texts = [" ".join(f"x{rnd.randrange(10**6)}" for _ in range(50)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:20])], "doc_id long, text string")
    got = {r.doc_id: r.score for r in ngram_lm.score(docs, F.lit(False)).collect()}
    assert min(got[i] for i in range(20)) > max(got[i] for i in range(20, 60))


def test_trie_finds_what_it_stores():
    rnd = np.random.RandomState(5)
    keys = np.unique(rnd.randint(0, 500, 3000).astype(np.uint64) << np.uint64(32) | rnd.randint(0, 900, 3000).astype(np.uint64))
    stored, low = rnd.rand(len(keys)) < 0.6, np.uint64(2**32 - 1)
    codes = rnd.randint(0, 250, stored.sum()).astype(np.uint8)
    trie = ngram_lm.Trie(ngram_lm.Trie.build(keys[stored] >> np.uint64(32), keys[stored] & low, codes))
    want = np.full(len(keys), ngram_lm.MISS, np.uint8)
    want[stored] = codes
    assert (trie.find(keys >> np.uint64(32), keys & low) == want).all()
    none = ngram_lm.Trie(ngram_lm.Trie.build(keys[:0], keys[:0], codes[:0]))
    assert (none.find(keys >> np.uint64(32), keys & low) == ngram_lm.MISS).all()
