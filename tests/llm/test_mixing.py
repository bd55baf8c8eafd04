"""Mixing against its targets, worked out in plain Python."""

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from biasframe.llm import mixing


def plain_targets(sizes, weights=(1, 2, 3), limit=3):
    """sizes: source -> words; the excess over the limit is shared again by weight."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(limit * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        more = {s for s in open_ if weight[s] * level >= limit * sizes[s]}
        if not more:
            return {s: limit * sizes[s] if s in full else weight[s] * level for s in names}
        full |= more


def check(rows, docs, near=0.01):
    sizes = Counter()
    for _, s, n in docs:
        sizes[s] += n
    goal, taken, shortest = plain_targets(sizes), Counter(), {}
    assert Counter((r.doc_id, r.source, r.size) for r in rows) == Counter(docs)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        if r.size:
            shortest[r.source] = min(r.size, shortest.get(r.source, r.size))
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= max(near * goal[s], shortest.get(s, 0)), (s, taken[s], goal[s])


def frame(spark, docs):
    return spark.createDataFrame([(i, s, "w " * n if n is not None else None, "x", 1) for i, s, n in docs], "doc_id long, source string, text string, size string, taken int")


def test_sources_come_near_their_targets(spark):
    # few documents of very different lengths, one very long one a source
    docs = [(1000 * k + i, f"src{k}", 1 + (i * i * 7 + k) % 900 + (5000 if i == 3 else 0)) for k in range(12) for i in range(60)]
    docs += [(5, None, 30), (6, None, 0), (None, "src1", 12), (None, None, 7)]
    check(mixing.mix(frame(spark, docs)).collect(), docs)
    again = mixing.mix(frame(spark, docs[::-1]).repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixing.mix(frame(spark, docs)).collect()))


@pytest.mark.parametrize("sf, near", [("sf0.001", 0.05), ("sf0.01", 0.01), ("sf0.1", 0.01)])  # ten, fifty, five hundred documents a source
def test_documents_come_near_their_targets(spark, sf, near):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "source", "text")
    plain = [(r.doc_id, r.source, len((r.text or "").encode().split())) for r in docs.collect()]
    check(mixing.mix(docs).collect(), plain, near)


def test_repeated_rows_are_one_unit(spark, monkeypatch):
    docs = [(1, "a", 3)] * 100 + [(2, "a", 0)] * 5 + [(3, "b", 50), (4, "b", 50), (4, "b", 50), (None, "b", 2), (None, "b", 2)]
    check(mixing.mix(frame(spark, docs)).collect(), docs, 0.02)
    monkeypatch.setattr(mixing, "STRETCH", 7)
    check(mixing.mix(frame(spark, docs)).collect(), docs, 0.02)
    many = spark.range(200_000).select(F.lit(9).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.lit("one two three").alias("text"))
    begun = time.time()
    got = mixing.mix(many.unionByName(frame(spark, docs).select("doc_id", "source", "text"))).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.count("*").alias("n")).collect()
    assert time.time() - begun < 60
    assert {r.source: r.n for r in got} == {"a": 200_105, "b": 5} and all(abs(r.t - r.g) <= max(3, 0.01 * r.g) for r in got)


def test_rows_are_repeated_as_often_as_they_are_taken(spark):
    docs = [(i, f"s{i % 3}", 1 + i % 40) for i in range(200)]
    want = {r.doc_id: r.copies for r in mixing.mix(frame(spark, docs)).collect()}
    got = Counter(r.doc_id for r in mixing.repeat_rows(frame(spark, docs)).collect())
    assert got == Counter({i: n for i, n in want.items() if n})
    assert mixing.repeat_rows(frame(spark, docs)).columns == ["doc_id", "source", "text", "size", "taken"]
    assert mixing.mix(frame(spark, docs).limit(0)).count() == 0
