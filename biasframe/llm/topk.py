"""Exact top-k inner products on a bit-sliced index (operator 7).

Vectors are quantised to integers. Per block of rows and per attribute the index
keeps one bitmap per bit. A query adds the slices of all attributes, weighted by
the bits of its own components, with carry-save adders on whole bitmaps; the sum
is again a list of slices. From the most significant slice downward, rows whose
bit is set are taken while they fit into k; the rows left equal at the end are
the boundary, of which those with the smallest ids are taken.

Defined cases: null vectors, vectors with null or non-finite components and
empty vectors take no part; vectors meet only those of their own length; a query
never meets rows of its own id; repeated rows are candidates each; an empty
table gives an empty result; other columns are not read. A vector whose
quantised components have squares that sum up to 2**62 or more fails the query
with a message: below that, no inner product leaves 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biasframe.llm.common import written

BLOCK_ROWS = 8192
QUERY_ROWS = 64


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, dim and q = floor(scale * x) of the usable vectors."""
    x = F.col("embedding")
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    q = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    length = F.aggregate(x, F.lit(0.0), lambda s, v: s + F.pow(F.floor(v.cast("double") * scale).cast("double"), F.lit(2)))
    q = F.when(length < 2.0**62, q).otherwise(F.raise_error(F.lit("a vector is too long for 64-bit inner products")).cast("array<long>"))
    return vectors.where(F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.size(x).alias("dim"), q.alias("q"))


def build_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Bit slices of a block: rows in id order; per attribute the least value
    and the bitmaps of the difference to it."""
    pdf = pdf.sort_values("vec_id", kind="stable")
    m = np.stack(pdf["q"].to_numpy()).astype(np.int64)
    low = m.min(0)
    bits = max(1, int((m.max(0) - low).max()).bit_length())
    words = -(-len(m) // 64)
    wide = np.zeros((m.shape[1], words * 64), np.int64)
    wide[:, :len(m)] = (m - low).T
    slices = np.stack([np.packbits((wide >> b & 1).astype(np.uint8), axis=1, bitorder="little") for b in range(bits)], 1)
    return pd.DataFrame({"dim": [m.shape[1]], "block": [pdf["block"].iloc[0]], "bits": [bits], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()],
                         "low": [low.tobytes()], "slices": [slices.tobytes()], "rows": [m.tobytes()]})


def index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per block of about ``block_rows`` vectors of one length."""
    n = vectors.count()
    blocks = max(1, -(-n // block_rows))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", F.col("q")), F.lit(blocks)).cast("int"))
    made = dealt.groupBy("dim", "block").applyInPandas(build_block, "dim int, block int, bits int, ids binary, low binary, slices binary, rows binary")
    return written(made, "bit_slices")


def add_slices(slices: np.ndarray, queries: np.ndarray) -> list[np.ndarray]:
    """The sums of |q| * y over the attributes as slices of (query, word)
    bitmaps; y is the difference to the least value where q > 0, and its
    complement where q < 0."""
    dims, bits, _ = slices.shape
    size = np.abs(queries)
    full, none = np.uint64(2**64 - 1), np.uint64(0)
    flip = np.where(queries < 0, full, none).astype(np.uint64)
    used = max(1, int(size.max(initial=0)).bit_length())
    on = [np.where(size >> j & 1, full, none).astype(np.uint64) for j in range(used)]
    wants = [np.flatnonzero((size >> j & 1).any(0)) for j in range(used)]
    out: list[np.ndarray] = []
    carried: list[np.ndarray] = []
    weight = 0
    while carried or weight < bits + used - 1:
        held, above = carried, []
        operands = [(d, weight - j, j) for j in range(used) if 0 <= weight - j < bits for d in wants[j]]
        for d, b, j in operands:
            held.append((slices[d, b][None, :] ^ flip[:, d, None]) & on[j][:, d, None])
            if len(held) == 3:  # a full adder: three bitmaps to a sum and a carry
                x, y, z = held
                u = x ^ y
                held = [u ^ z]
                above.append((x & y) | (u & z))
        while len(held) >= 3:
            x, y, z = held.pop(), held.pop(), held.pop()
            u = x ^ y
            held.append(u ^ z)
            above.append((x & y) | (u & z))
        if len(held) == 2:
            x, y = held
            held = [x ^ y]
            above.append(x & y)
        out.append(held[0] if held else np.zeros((len(queries), slices.shape[2]), np.uint64))
        carried, weight = above, weight + 1
    return out


def select_top(sums: list[np.ndarray], allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the rows surely among the top k, and of those on the boundary."""
    taken, equal = np.zeros_like(allowed), allowed.copy()
    for s in reversed(sums):
        more = taken | (equal & s)
        n = np.bitwise_count(more).sum(1)[:, None]
        taken = np.where(n <= k, more, taken)
        equal = np.where(n > k, equal & s, equal & ~s)
    return taken, equal


def search_block(block: dict, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of the k best rows of a block for each query."""
    dim, bits = block["dim"], block["bits"]
    ids = np.frombuffer(block["ids"], np.int64)
    rows = np.frombuffer(block["rows"], np.int64).reshape(len(ids), dim)
    slices = np.frombuffer(block["slices"], np.uint64).reshape(dim, bits, -1)
    allowed = np.zeros((len(queries), slices.shape[2] * 64), np.uint8)
    allowed[:, :len(ids)] = ids[None, :] != query_ids[:, None]
    allowed = np.packbits(allowed, axis=1, bitorder="little").view(np.uint64)
    taken, equal = select_top(add_slices(slices, queries), allowed, k)
    for i, q in enumerate(queries):
        sure = np.flatnonzero(np.unpackbits(taken[i].view(np.uint8), bitorder="little"))
        edge = np.flatnonzero(np.unpackbits(equal[i].view(np.uint8), bitorder="little"))[:k - len(sure)]  # rows stand in id order
        at = np.r_[sure, edge]
        yield int(query_ids[i]), ids[at], rows[at] @ q


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every query. Both are
    tables as ``quantised`` returns them. Queries meet the index in units of one
    chunk of queries and one block; the unit sends on k rows per query."""
    blocks = index(vectors, block_rows)
    known = written(blocks.select("dim", "block"), "block_list")
    n = queries.count()
    chunks = max(1, -(-n // QUERY_ROWS))
    chunk = F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(chunks)).cast("int").alias("chunk")
    asked = queries.groupBy("dim", chunk).agg(F.collect_list(F.struct("vec_id", "q")).alias("asked"))
    units = asked.join(known, "dim").join(blocks, ["dim", "block"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for unit in pdf.to_dict("records"):
                asked = unit["asked"]
                for at in range(0, len(asked), QUERY_ROWS):
                    part = asked[at:at + QUERY_ROWS]
                    qids = np.array([a["vec_id"] for a in part], np.int64)
                    q = np.array([np.asarray(a["q"], np.int64) for a in part], np.int64)
                    found = list(search_block(unit, qids, q, k))  # at most k rows for each query of the chunk, sent on together
                    yield pd.DataFrame({"query_id": np.repeat([i for i, _, _ in found], [len(ids) for _, ids, _ in found]).astype(np.int64),
                                        "vec_id": np.concatenate([ids for _, ids, _ in found]), "score": np.concatenate([x for _, _, x in found])})

    found = units.mapInPandas(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
