"""Extreme ids, large numbers, repeated rows and null ids."""

import base64
import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from biasframe.llm import sharding, topk, warc


def test_any_page_id_comes_back(spark):
    ids = [-5, 2**63 - 1, -2**63, 1234567890123456789, 0, None, 7, 7]
    rows = [(i, "u", h) for i in ids for h in ("same", f"own {i}")] + [(None, None, None), (8, "u", ""), (8, "u", "")]
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    want = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        same = [j for j, _, x in rows if (x or "") == (h or "")]
        best = max((j for j in same if j is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want[i, len(raw), digest, "response" if i == best else "revisit", None if i == best else best] += 1
    assert got == want


def test_large_components_are_exact_or_refused(spark):
    def quantised(rows):
        return topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))

    big = quantised([(0, [2.0**23, -(2.0**22)]), (1, [2.0**23, 3.0]), (20, [-(2.0**23), 0.25]), (3, [0.0, 1.0])])
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(big, big.where("vec_id % 20 = 0"), 3).collect()}
    q = {r.vec_id: list(r.q) for r in big.collect()}
    for i in (0, 20):
        best = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i)
        assert [got[i, k + 1] for k in range(3)] == [(j, -s) for s, j in best]
    for x in ([1e300, 1.0], [1e15, -1e15], [2.0**26, 0.0]):
        with pytest.raises(Exception, match="too long"):
            quantised([(0, x), (1, [1.0, 2.0])]).collect()


def test_layout_of_repeated_rows_and_null_ids(spark):
    rows = [(i % 50 if i % 9 else None, "text " * (i % 17)) for i in range(400)] + [(3, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    laid = sharding.write_layout(docs, 3, sharding.text_bytes(F.col("text")) + 1)
    total = laid.agg(F.sum("_rs_size")).first()[0]
    assert total == sum(len((t or "").encode()) + 1 for _, t in rows)
    kept = sharding.reshard(laid, [total // 5 + (i < total % 5) for i in range(5)])
    got = kept.select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("c"), "_rs_shard", (sharding.text_bytes(F.col("text")) + 1).alias("n")).collect()
    assert Counter((r.doc_id, r.c) for r in got) == Counter((i, zlib.crc32((t or "").encode())) for i, t in rows)
    sizes = Counter()
    for r in got:
        sizes[r["_rs_shard"]] += r.n
    assert set(sizes) == set(range(5)) and max(sizes.values()) - min(sizes.values()) <= 2 * 85
