"""Vector code compression with adaptive distance bounds (operator 13).

Vectors of whole numbers are cut into equal consecutive parts, and every part
position gets a codebook by rounds of nearest-entry assignment and rounded-down
means. A pass over the table assigns all parts and writes the state of every
part: its ``b`` closest entries in order, a lower bound of the distance to each,
and one bound for all entries outside these; sums by entry, one small table a
task, give the next codebook. When entries have moved, the bounds sink by the
moves: every listed entry's by its own, the outer one by the greatest move of
an entry outside the list. A part whose entry is surely still the nearest (its exact distance is strictly below
all bounds) is done. For others the listed entries are measured in whole
numbers; only if the outer bound is not above that distance either, all entries
are. Ties go to the lower index, so a bound that is equal decides nothing. Every
pass adapts ``b`` to the number of listed entries that most parts of a batch needed;
entries that leave a list lower its outer bound. Bounds are 16-bit numbers
rounded down; codes and errors never come from them.

Defined cases: null vectors, empty ones and vectors with null or non-finite
components are dropped; so are those whose length is no multiple of the number
of parts, or not that of the first vector left (by id, null ids last); repeated
ids and rows are kept each, and the first rows by id, then vector, open the
codebooks, fewer if there are fewer; null labels are one label; a whole component
beyond 2**24 fails the query with a message, as squared distances could leave 64
bits; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biasframe.llm.common import written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
FIRST_B, LEAST_B = 8, 4
#: The new ``b`` covers what this share of the parts needed.
COVERED = 0.9
ROWS = 4096
LARGEST = 2**24  # of a component: squared distances of 8,192 components stay below 2**63
LOWER, UPPER = np.float32(1 - 1e-5), np.float32(1 + 1e-5)  # more than the rounding of a few 32-bit steps
LABEL_AND_STATE = "code binary, error long, near binary, bound binary, outer binary, b int, measured long"


def whole_vectors(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """vec_id, label and q = floor(scale * x) of the usable vectors."""
    x = F.col("embedding")
    fine = x.isNotNull() & (F.size(x) > 0) & (F.size(x) % parts == 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    scaled = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    q = F.when(F.forall(scaled, lambda v: F.abs(v) <= LARGEST), F.transform(scaled, lambda v: v.cast("int"))).otherwise(
        F.raise_error(F.lit(f"components must be at most {LARGEST // scale} in size")).cast("array<int>"))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), "label", q.alias("q"))


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries."""
    if max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)) < 2**20:  # whole numbers below 2**53 are exact in doubles
        f, g = x.astype(np.float64), book.astype(np.float64)
        return ((f * f).sum(1)[:, None] - 2 * (f @ g.T) + (g * g).sum(1)).astype(np.int64)
    return sum((x[:, None, j] - book[None, :, j]) ** 2 for j in range(x.shape[1]))


def below(d2: np.ndarray) -> np.ndarray:
    """A lower bound of the root of whole numbers."""
    return np.sqrt(d2.astype(np.float64)).astype(np.float32) * LOWER


def down(bound: np.ndarray) -> np.ndarray:
    """Bounds as 16-bit numbers, never higher."""
    small = np.minimum(bound, np.float32(65504)).astype(np.float16)
    small = np.where(small > bound, np.nextafter(small, np.float16(0)), small)
    return np.where(np.isinf(bound), np.float16(np.inf), small)


def nearest(d2: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The b closest entries in order, their bounds, and the outer bound."""
    k = d2.shape[1]
    if b + 1 < k and d2.max(initial=0) < 2**54:  # distance and index in one number
        order = np.sort(np.partition(d2 * k + np.arange(k), b, 1)[:, :b + 1], 1) % k
    else:
        order = np.argsort(d2, 1, kind="stable")[:, :b + 1]
    bound = below(np.take_along_axis(d2, order, 1))
    return order[:, :b].astype(np.uint8), bound[:, :b], bound[:, b] if b < k else np.full(len(d2), np.inf, np.float32)


def reassign(x: np.ndarray, book: np.ndarray, move: np.ndarray, near: np.ndarray, bound: np.ndarray, outer: np.ndarray):
    """One part position after its entries moved: the listed entries, their
    bounds, the outer bound, the squared distance to the first, the number of
    listed entries that were needed, and of entries that were measured."""
    held, k = near.shape[1], len(book)
    top = np.argsort(-move, kind="stable")
    far = np.full(len(x), move[top[0]], np.float32)  # the greatest move outside the list
    inside = (near == top[0]).any(1)
    for e in top[1:held + 1].tolist():
        far[inside] = move[e]
        inside &= (near == e).any(1)
    bound = np.maximum(bound - move[near], 0) * LOWER
    outer = np.maximum(outer - far, 0) * LOWER
    d2 = ((x - book[near[:, 0]]) ** 2).sum(1)
    reach = np.sqrt(d2.astype(np.float64)).astype(np.float32) * UPPER
    bound[:, 0] = below(d2)
    needed = 1 + (bound[:, 1:] <= reach[:, None]).sum(1)
    every = np.flatnonzero(outer <= reach)
    some = np.flatnonzero((needed > 1) & (outer > reach))
    if len(some):
        ids = near[some].astype(np.int64)
        close = ((x[some, None, :] - book[ids]) ** 2).sum(2)
        by = np.lexsort((ids, close), axis=1)
        near[some], close = np.take_along_axis(near[some], by, 1), np.take_along_axis(close, by, 1)
        bound[some], d2[some] = below(close), close[:, 0]
    if len(every):
        full = distances(x[every], book)
        near[every], bound[every], outer[every] = nearest(full, held)
        d2[every] = np.take_along_axis(full, near[every, :1].astype(np.int64), 1)[:, 0]
        needed[every] = held
    by = np.argsort(bound[:, 1:], 1, kind="stable") + 1  # lists stay ordered by bound behind the nearest
    near[:, 1:], bound[:, 1:] = np.take_along_axis(near, by, 1), np.take_along_axis(bound, by, 1)
    measured = np.ones(len(x), np.int64)
    measured[some], measured[every] = held, k + 1
    return near, bound, outer, d2, needed, measured


def assign(vectors: DataFrame, book: np.ndarray, before: np.ndarray | None = None, b: int = FIRST_B) -> DataFrame:
    """One pass over the table. ``book`` is (parts, entries, width); ``before`` is
    the codebook by which the state columns were written, None in the first pass."""
    parts, k, width = book.shape
    moves = None if before is None else np.sqrt(((book - before) ** 2).sum(2).astype(np.float64)).astype(np.float32) * UPPER

    def opened(x: np.ndarray) -> tuple:
        found = []
        for p in range(parts):
            d2 = distances(x[:, p], book[p])
            near, bound, outer = nearest(d2, min(b, k))
            found.append((near, bound, outer, np.take_along_axis(d2, near[:, :1].astype(np.int64), 1)[:, 0], np.full(len(x), near.shape[1]), np.full(len(x), k)))
        return tuple(np.stack(v, 1) for v in zip(*found))

    def moved(x: np.ndarray, part: pa.RecordBatch, at: np.ndarray, held: int) -> tuple:
        rows = part.take(pa.array(at))
        near, bound, outer = (np.frombuffer(b"".join(rows.column(c).to_pylist()), t).reshape(len(at), parts, -1)
                              for c, t in (("near", np.uint8), ("bound", np.float16), ("outer", np.float16)))
        found = [reassign(x[at, p], book[p], moves[p], near[:, p].copy(), bound[:, p].astype(np.float32), outer[:, p, 0].astype(np.float32)) for p in range(parts)]
        return tuple(np.stack(v, 1) for v in zip(*found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                x = part.column("q").flatten().to_numpy().reshape(part.num_rows, parts, width).astype(np.int64)
                held = np.zeros(part.num_rows, np.int64) if moves is None else part.column("b").to_numpy()
                for size in np.unique(held).tolist():  # rows of other batches may have lists of another size
                    at = np.flatnonzero(held == size)
                    near, bound, outer, d2, needed, measured = opened(x[at]) if moves is None else moved(x, part, at, size)
                    if moves is not None:
                        enough = int(np.quantile(needed, COVERED, method="higher"))
                        keep = min(near.shape[2], max(enough, LEAST_B))
                        if keep < near.shape[2]:
                            outer = np.minimum(outer, bound[:, :, keep:].min(2))
                            near, bound = near[:, :, :keep], bound[:, :, :keep]
                    rows = part.take(pa.array(at))
                    packed = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (near[:, :, 0], near, down(bound), down(outer))]
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("vec_id"), rows.column("label"), rows.column("q"), packed[0], pa.array(d2.sum(1), pa.int64()), *packed[1:],
                         pa.array(np.full(len(at), near.shape[2]), pa.int32()), pa.array(measured.sum(1), pa.int64())],
                        names=["vec_id", "label", "q", "code", "error", "near", "bound", "outer", "b", "measured"])

    return vectors.mapInArrow(run, f"vec_id long, label {vectors.schema['label'].dataType.simpleString()}, q array<int>, {LABEL_AND_STATE}")


def means(assigned: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebook of rounded-down means; unused entries stay. A task sends one
    sum for each component of each entry."""
    parts, k, width = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, k, width + 1), np.int64)
        for batch in batches:
            x = batch.column("q").flatten().to_numpy().reshape(batch.num_rows, parts, width)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, parts)
            for p in range(parts):
                order = np.argsort(code[:, p], kind="stable")
                used, first = np.unique(code[order, p], return_index=True)
                if len(used):
                    total[p, used, :width] += np.add.reduceat(x[order, p].astype(np.int64), first, axis=0)
                total[p, :, width] += np.bincount(code[:, p], minlength=k)
        flat = total.reshape(-1)
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(flat[at], pa.int64())], names=["slot", "total"])

    total = np.zeros(parts * k * (width + 1), np.int64)
    for r in assigned.select("q", "code").mapInArrow(run, "slot int, total long").groupBy("slot").agg(F.sum("total").alias("total")).collect():
        total[r.slot] = r.total  # as many rows as a codebook has numbers
    total = total.reshape(parts, k, width + 1)
    n = total[:, :, width:]
    return np.where(n > 0, total[:, :, :width] // np.maximum(n, 1), book)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code (one byte a part), error and ``measured`` (the number of
    distances taken in the last pass) of every usable vector, and the codebooks
    as an array (parts, entries, width of a part)."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's number is one byte")
    usable = whole_vectors(vectors, parts, scale)
    opening = usable.orderBy(F.asc_nulls_last("vec_id"), "q").limit(entries).collect()
    width = len(opening[0].q) // parts if opening else 1
    # the first vectors of the common length, should others come before them
    usable = usable.where(F.size("q") == parts * width)
    if any(len(r.q) != parts * width for r in opening):
        opening = usable.orderBy(F.asc_nulls_last("vec_id"), "q").limit(entries).collect()
    book = np.array([r.q for r in opening], np.int64).reshape(len(opening), parts, width).transpose(1, 0, 2)
    if not opening:
        return usable.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("measured")), book
    state, before = written(assign(usable, book), "codes"), book
    for _ in range(rounds):
        book = means(state, before)
        state, before = written(assign(state, book, before), "codes"), book
    return state.select("vec_id", "label", "code", "error", "measured"), book


def code_table(vectors: DataFrame) -> DataFrame:
    """The codes in hex digits, the error summed by label, and the codebooks' digest."""
    coded, book = compress(vectors)
    digest = hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    c = [f"c{j}" for j in range(4)]
    gap = " + ".join(f"(x.{j} - b.{j}) * (x.{j} - b.{j})" for j in c)
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, p, min(({gap}) * 64 + e) AS k FROM x JOIN b{r} b USING (p) GROUP BY vec_id, p)")
        if r < ROUNDS:
            mean = ", ".join(f"coalesce((s.{j} - ((s.{j} % n + n) % n)) // n, b.{j})::BIGINT AS {j}" for j in c)
            sums = ", ".join(f"sum({j})::BIGINT AS {j}" for j in c)
            steps.append(f"""b{r + 1} AS MATERIALIZED (SELECT p, e, {mean} FROM b{r} b LEFT JOIN
              (SELECT p, k % 64 AS e, count(*) AS n, {sums} FROM a{r} JOIN x USING (vec_id, p) GROUP BY ALL) s USING (p, e))""")
    numbers = " || ',' || ".join(c)
    return f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda y: floor(256 * y::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS MATERIALIZED (SELECT vec_id, p, {", ".join(f"q[4 * p + {j + 1}] AS c{j}" for j in range(4))} FROM v, range(16) r(p)),
b0 AS MATERIALIZED (
  SELECT p, e, {", ".join(c)} FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v) USING (vec_id) WHERE e < 64),
{", ".join(steps)},
coded AS (SELECT vec_id, string_agg(format('{{:02x}}', k % 64), '' ORDER BY p) AS code, sum(k // 64)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id),
book AS (SELECT sha256(string_agg({numbers}, ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN v USING (vec_id), book
"""


CODES_SQL = _sql()
