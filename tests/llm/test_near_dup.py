"""Packed signatures, and groups that only the later steps can join."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from biasframe.llm import near_dup


def test_bit_counts_equal_bytes(spark):
    rnd = np.random.RandomState(8)
    pairs = []
    for k in range(60):
        a = rnd.randint(0, 256, near_dup.BANDS * near_dup.ROWS).astype(np.uint8)
        b = np.where(rnd.rand(len(a)) < k / 60, a, rnd.randint(0, 256, len(a))).astype(np.uint8)
        pack = lambda x: np.frombuffer(x.tobytes() + bytes(near_dup.PAD), np.int64).tolist()
        pairs.append((pack(a), pack(b), int((a == b).sum())))
    df = spark.createDataFrame(pairs, "a array<long>, b array<long>, want int")
    assert all(r.got == r.want for r in df.select(near_dup.agreeing(F.col("a"), F.col("b")).alias("got"), "want").collect())


@pytest.mark.parametrize("width", [2, 5])
def test_groups_equal_brute_force(spark, width, monkeypatch):
    """Chains of edits, so that groups hold members unlike their least id, among texts
    that share long passages without being alike."""
    monkeypatch.setattr(near_dup, "CHUNK", 8)
    rnd = random.Random(width)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for f in range(12):
        words = [f"f{f}w{i}" for i in range(90)] + passage
        for _ in range(14):
            words = list(words)
            for _ in range(rnd.randint(1, 5)):
                words[rnd.randrange(90)] = f"n{rnd.randrange(10**6)}"
            texts.append(" ".join(words))
    texts += [" ".join(passage + [f"x{i}y{j}" for j in range(40)]) for i in range(40)]
    order = list(range(len(texts)))
    rnd.shuffle(order)
    docs = spark.createDataFrame([(i, texts[k]) for i, k in enumerate(order)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs, width).collect()}
    sets = []
    for k in order:
        w = texts[k].split()
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)})
    group = list(range(len(sets)))
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in range(len(sets)):
        before = list(group)
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
        if group == before:
            break
    assert got == dict(enumerate(group)) and len(set(group)) < len(group) - 50
