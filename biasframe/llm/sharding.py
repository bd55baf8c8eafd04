"""Minimum-cost-flow resharding (operator 10).

The old layout holds blocks: files of neighbouring rows of one old shard. From
the old shards' bytes and the new shards' capacities a flow is solved that moves
the fewest bytes; the flow cuts each old shard, in the order of its blocks, into
stretches for its new shards. Whole blocks move or stay; a block on a cut is
split between rows. Only files of affected blocks are rewritten, all others
stay where they are.

Defined cases: null text has 0 bytes; null ids are placed like others (by the
hash of id and text); equal rows go to the same shard; an empty table gives an
empty layout; texts of any length are moved whole; other columns are carried
along, and working names start with ``_rs_``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biasframe.llm.common import scratch, written

BLOCK_BYTES = 128 << 20
MIN_BLOCKS = 8
_PLACE = ["_rs_old", "_rs_block"]


def solve_flow(supply: Sequence[int], room: Sequence[int]) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard, moving the fewest: successive
    shortest paths, where keeping bytes in their shard costs 0 and moving them
    costs 1. The graph has one node per shard, whatever the data."""
    n, m = len(supply), len(room)
    source, sink = n + m, n + m + 1
    left: dict[tuple[int, int], int] = {}
    cost: dict[tuple[int, int], int] = {}

    def arc(u: int, v: int, c: int, w: int) -> None:
        left[u, v], left[v, u], cost[u, v], cost[v, u] = c, 0, w, -w

    for i, s in enumerate(supply):
        arc(source, i, s, 0)
        for j in range(m):
            arc(i, n + j, s, int(i != j))
    for j, r in enumerate(room):
        arc(n + j, sink, r, 0)
    while True:
        dist, back = {source: 0}, {}
        for _ in range(n + m + 2):
            changed = False
            for (u, v), c in left.items():
                if c > 0 and u in dist and dist[u] + cost[u, v] < dist.get(v, 1 << 30):
                    dist[v], back[v], changed = dist[u] + cost[u, v], u, True
            if not changed:
                break
        if sink not in back:
            break
        path, v = [], sink
        while v != source:
            path.append((back[v], v))
            v = back[v]
        step = min(left[e] for e in path)
        for u, v in path:
            left[u, v] -= step
            left[v, u] += step
    return {(i, j): left[n + j, i] for i in range(n) for j in range(m) if left[n + j, i] > 0}


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def write_layout(docs: DataFrame, shards: int, size: Column, id_col: str = "doc_id", text_col: str = "text",
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Lay ``docs`` out as blocks of ``shards`` shards, one file folder each, in
    the shared folder. Adds _rs_size, _rs_key (the order in a shard), _rs_old and
    _rs_block. The number of blocks follows the bytes."""
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    blocks = max(MIN_BLOCKS, -(-total // (shards * block_bytes)))
    key = F.call_function("shiftrightunsigned", F.xxhash64(id_col, text_col), F.lit(2))
    laid = docs.withColumns({"_rs_size": size, "_rs_key": key})
    laid = laid.withColumns({"_rs_old": F.pmod(F.xxhash64("_rs_key"), F.lit(shards)).cast("int"),
                             "_rs_block": F.shiftright(F.shiftright("_rs_key", 31) * F.lit(blocks).cast("long"), 31).cast("long")})
    path = scratch(spark, "layout")
    laid.repartition(*_PLACE).write.partitionBy(*_PLACE).parquet(path)
    return spark.read.schema(laid.schema).parquet(path)


def plan_moves(laid: DataFrame, capacities: Sequence[int]) -> DataFrame:
    """_rs_old, _rs_block, shard, low, high: where the rows of each block go, by
    ranges of _rs_key. Collects one number per shard, nothing per row or block."""
    spark = laid.sparkSession
    blocks = written(laid.groupBy(*_PLACE).agg(F.sum("_rs_size").alias("bytes")), "blocks")
    held = {r[0]: r[1] for r in blocks.groupBy("_rs_old").agg(F.sum("bytes")).collect()}
    supply = [held.get(i, 0) for i in range(max(held, default=0) + 1)]
    if sum(supply) > sum(capacities):
        raise ValueError("the new shards hold fewer bytes than the old ones have")
    flow = solve_flow(supply, capacities)
    stretches = []
    for i in range(len(supply)):
        at = 0
        for j in sorted(range(len(capacities)), key=lambda j: (j != i, j)):  # what stays comes first
            if (i, j) in flow:
                stretches.append((i, j, at, at + flow[i, j]))
                at += flow[i, j]
    cuts = spark.createDataFrame(stretches, "_of int, shard int, first long, past long")
    w = Window.partitionBy("_rs_old").orderBy("_rs_block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("start", F.coalesce(F.sum("bytes").over(w), F.lit(0)))
    whole = placed.join(cuts, (F.col("_rs_old") == F.col("_of")) & (F.col("start") >= F.col("first"))
                        & (F.col("start") + F.col("bytes") <= F.col("past")) & (F.col("start") < F.col("past")))
    whole = written(whole.select(*_PLACE, "shard", F.lit(-(1 << 63)).alias("low"), F.lit((1 << 63) - 1).alias("high")), "whole_blocks")
    # the few blocks on a cut: place their rows one by one, equal keys together
    split = written(placed.join(whole.select(*_PLACE), _PLACE, "left_anti"), "cut_blocks")
    rows = laid.select(*_PLACE, "_rs_key", "_rs_size").join(split, _PLACE)
    by_key = rows.groupBy(*_PLACE, "_rs_key").agg(F.sum("_rs_size").alias("size"), F.max("start").alias("start"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy(*_PLACE).orderBy("_rs_key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    middle = by_key.withColumn("middle", F.col("start") + before + F.floor(F.col("size") / 2))
    parts = middle.join(cuts, (F.col("_rs_old") == F.col("_of")) & (F.col("middle") >= F.col("first")) & (F.col("middle") < F.col("past")))
    parts = parts.groupBy(*_PLACE, "shard").agg(F.min("_rs_key").alias("low"), F.max("_rs_key").alias("high"))
    return written(whole.unionByName(parts), "moves")


def reshard(laid: DataFrame, capacities: Sequence[int]) -> DataFrame:
    """The rows of ``laid`` with their new ``_rs_shard``, read from the new
    layout: rewritten files of affected blocks, and all other files as they are."""
    spark = laid.sparkSession
    moves = plan_moves(laid, capacities)
    affected = written(moves.where("shard <> _rs_old").select(*_PLACE).distinct(), "affected")
    names = [c for c in laid.columns if c not in _PLACE]
    goal = written(moves.join(affected, _PLACE), "affected_moves")
    moved = laid.join(goal, _PLACE).where(F.col("_rs_key").between(F.col("low"), F.col("high")))
    moved = moved.select(*names, *_PLACE, F.col("shard").alias("_rs_shard"))
    path = scratch(spark, "resharded")
    moved.write.partitionBy("_rs_shard").parquet(path)
    rewritten = spark.read.schema(moved.schema).parquet(path)
    stayed = laid.join(affected, _PLACE, "left_anti").select(*names, *_PLACE, F.col("_rs_old").alias("_rs_shard"))
    return rewritten.unionByName(stayed)


def with_slots(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``rows`` (narrow, with _rs_shard, _rs_old, _rs_block, _rs_key) with a
    gapless ``slot`` per shard: positions within a block, and the counts of the
    blocks before it."""
    block = ["_rs_shard", *_PLACE]
    counts = written(rows.groupBy(*block).agg(F.count(F.lit(1)).alias("_rs_n")), "block_counts")
    before = Window.partitionBy("_rs_shard").orderBy(*_PLACE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(counts.select(*block, F.coalesce(F.sum("_rs_n").over(before), F.lit(0)).alias("_rs_before")), "block_offsets")
    place = F.row_number().over(Window.partitionBy(*block).orderBy("_rs_key", id_col))
    return rows.withColumn("_rs_place", place).join(offsets, block).withColumn("slot", F.col("_rs_before") + F.col("_rs_place") - 1)
