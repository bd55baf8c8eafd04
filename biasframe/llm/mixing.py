"""Mixing sources to target weights by pivotal dependent rounding (operator 5),
DataFrame functions only.

Every document of a source should be taken f times, f = target / size of the
source. The whole part is certain; the fractional parts, the probabilities of one
more copy, are rounded together: two documents meet, mass (probability times
words) is moved from one to the other in a random direction until the
probability of one is 0 or 1, and the other goes on with what remains, so the mass
of a source is kept. Meetings run in small blocks that are spread by a hash; each
block leaves one residual, and the residuals form the blocks of the next level,
until one is left per source: a reduction tree whose levels shrink by the block
size. That last residual, often a long document, is drawn by its probability;
the words by which the draw is off are given back over documents of falling
length that were rounded: a few of each order of magnitude change sides while
that brings the sum closer. So a source is off by less than its shortest open
document, if it has documents of all magnitudes below.

Rows with equal id, source and size stand for one unit with a count: of n such
rows with probability p, floor(n p) get the copy for certain, and one is open with
what remains. So no number of repeated rows makes a block or a task large.

Defined cases: null text has size 0; documents of size 0 are taken 0 times
their size; a null source is a source of its own, ranked last; an empty table
gives an empty result; of repeated rows as many as the mix takes have the larger
number; results depend on ids, sources, sizes and the seed only, so reruns
agree; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biasframe.llm.common import let, word_count, written
from biasframe.operators.ordering import dense_index

BLOCK = 64
LIMIT = 3
#: Documents of a source, side and order of magnitude that may change sides at the end.
SPARE = 64
#: The longest of these that may change sides against the draw.
SWINGS = 4
#: Rows of one unit that one task writes at a time.
STRETCH = 65_536
_DOC = "struct<doc_id:bigint,size:bigint,extra:int>"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = LIMIT) -> DataFrame:
    """source, source_size, target. Weights repeat over the sources by code
    point; a target stops at ``limit`` times its source, and the excess is
    shared again by weight until none is above. The loop reads a few sums of the
    table of sources; it ends as each turn stops at least one more source."""
    spark = sizes.sparkSession
    totals = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source_sizes")
    ranked = dense_index(totals, [F.col("source").isNull(), F.col("source")], name="_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = written(ranked.select("source", "source_size", weight.alias("_weight")), "source_weights")
    most, level, stopped = limit * F.col("source_size"), None, -1
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    while True:
        full = F.lit(False) if level is None else F.col("_weight") * level >= most
        got = ranked.agg(F.coalesce(F.sum(F.when(full, most)), F.lit(0)).alias("kept"), F.count(F.when(full, 1)).alias("n"),
                         F.coalesce(F.sum(F.when(~full, F.col("_weight"))), F.lit(0.0)).alias("weight")).first()
        if got.n == stopped or got.weight == 0:
            break
        stopped, level = got.n, (total - got.kept) / got.weight
    shared = F.col("_weight") * F.lit(float(level or 0.0))
    return written(ranked.select("source", "source_size", F.least(most.cast("double"), shared).alias("target")), "targets")


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _meet(state: Column, unit: Column, seed: Column) -> Column:
    """One meeting: ``state`` is (unit going on, decided documents)."""
    a, b = state["on"], unit

    def move(d: Column) -> Column:  # d: most mass that can go from b to a, and from a to b
        up = _uniform(seed, b["doc_id"], b["size"], a["doc_id"]) * (d["in"] + d["out"]) < d["out"]
        return let(F.struct(up.alias("up"), F.when(up, a["mass"] + d["in"]).otherwise(a["mass"] - d["out"]).alias("a"),
                            F.when(up, b["mass"] - d["in"]).otherwise(b["mass"] + d["out"]).alias("b")), settle)

    def settle(m: Column) -> Column:
        eps = F.lit(1e-6)
        a_done = (m["a"] <= eps) | (m["a"] >= a["size"] - eps)

        def doc(x: Column, mass: Column) -> Column:
            return F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), (mass > x["size"] / 2).cast("int").alias("extra"))

        def going(x: Column, mass: Column) -> Column:
            return F.struct(x["size"].alias("size"), x["doc_id"].alias("doc_id"), mass.alias("mass"))

        return F.when(a_done, F.struct(going(b, m["b"]).alias("on"), F.concat(state["out"], F.array(doc(a, m["a"]))).alias("out"))) \
                .otherwise(F.struct(going(a, m["a"]).alias("on"), F.concat(state["out"], F.array(doc(b, m["b"]))).alias("out")))

    room = F.struct(F.least(a["size"] - a["mass"], b["mass"]).alias("in"), F.least(a["mass"], b["size"] - b["mass"]).alias("out"))
    return let(room, move)


def _round_blocks(units: DataFrame, seed: int, level: int) -> DataFrame:
    """source, on (the residual of each block), out (its decided documents)."""
    blocks = units.groupBy("source", "_block").agg(F.sort_array(F.collect_list(F.struct("size", "doc_id", "mass")), asc=False).alias("_u"))
    rest = F.slice("_u", F.lit(2), F.greatest(F.size("_u") - 1, F.lit(0)))
    start = F.struct(F.element_at("_u", 1).alias("on"), F.expr(f"cast(array() as array<{_DOC}>)").alias("out"))
    done = F.aggregate(rest, start, lambda s, u: _meet(s, u, F.lit(seed * 64 + level)))
    return blocks.select("source", done.alias("_s")).select("source", "_s.on", "_s.out")


def _blocked(units: DataFrame, level: int) -> DataFrame:
    """Units with a block each: about ``BLOCK`` of a source share one."""
    counts = units.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_n")).withColumnRenamed("source", "_of")
    counts = written(counts, f"blocks_{level}")
    place = F.pmod(F.xxhash64(F.lit(level), "doc_id", "size"), F.col("_n"))
    return units.join(counts, F.col("source").eqNullSafe(F.col("_of"))).select("source", "doc_id", "size", "mass", place.alias("_block"))


def _given_back(decided: DataFrame, mass: DataFrame, seed: int) -> DataFrame:
    """source, doc_id, size, extra after each source's error was given back.
    ``mass``: source, mass (what its open documents should take). The documents
    that may change sides are at most ``SPARE`` of each source and binary order of
    magnitude, so a source's list is bounded whatever its size."""
    got = decided.groupBy(F.col("source").alias("_of")).agg(F.sum(F.col("size") * F.col("extra")).alias("_got"))
    off = mass.join(got, F.col("source").eqNullSafe(F.col("_of"))).select(F.col("source").alias("_of"), (F.col("_got") - F.col("mass")).alias("_off"))
    off = written(off, "errors")
    order = Window.partitionBy("source", "extra", F.floor(F.log2("size"))).orderBy(F.xxhash64(F.lit(seed), "doc_id", "size"), "doc_id", "size")
    some = decided.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= SPARE).join(off, F.col("source").eqNullSafe(F.col("_of")))
    listed = some.groupBy("source").agg(F.first("_off").cast("double").alias("_off"), F.sort_array(F.collect_list(F.struct("size", "doc_id", "extra")), asc=False).alias("_c"))
    doc = "struct<size:bigint,doc_id:bigint,extra:int>"

    def signed(d: Column) -> Column:  # what a change of sides does to the sum
        return F.when(d["extra"] == 1, -d["size"]).otherwise(d["size"])

    def change(state: Column, c: Column) -> Column:  # from the longest down, those that fit into what is left
        fits = c["size"] <= state["left"]
        return F.struct(F.when(fits, state["left"] - c["size"]).otherwise(state["left"]).alias("left"),
                        F.when(fits, F.concat(state["out"], F.array(c))).otherwise(state["out"]).alias("out"),
                        F.when(fits, state["over"]).otherwise(c).alias("over"))

    def end(state: Column) -> Column:  # the shortest that did not fit, if the sum comes closer with it
        closer = state["over"].isNotNull() & (state["over"]["size"] - state["left"] < state["left"])
        return F.struct(F.when(closer, state["over"]["size"] - state["left"]).otherwise(state["left"]).alias("left"),
                        F.when(closer, F.concat(state["out"], F.array(state["over"]))).otherwise(state["out"]).alias("out"))

    def solve(way: Column) -> Column:
        pool = F.filter("_c", lambda c: (c["extra"] == (way["off"] > 0).cast("int")) & (way["swing"].isNull() | (c != way["swing"])))
        start = F.struct(F.abs(way["off"]).alias("left"), F.when(way["swing"].isNull(), F.expr(f"cast(array() as array<{doc}>)")).otherwise(F.array(way["swing"])).alias("out"),
                         F.expr(f"cast(null as {doc})").alias("over"))
        return F.aggregate(pool, start, change, end)

    # as it was drawn, or with one of the longest documents on the other side
    ways = F.concat(F.array(F.struct(F.col("_off").alias("off"), F.expr(f"cast(null as {doc})").alias("swing"))),
                    F.transform(F.slice("_c", 1, SWINGS), lambda d: F.struct((F.col("_off") + signed(d)).alias("off"), d.alias("swing"))))
    solved = F.transform(ways, lambda w: let(solve(w), lambda x: F.struct(x["left"].alias("left"), F.size(x["out"]).alias("n"), x["out"].alias("out"))))
    changed = listed.select("source", F.explode(F.array_min(solved)["out"]).alias("_c"))
    changed = changed.select(F.col("source").alias("_of"), F.col("_c.doc_id").alias("_id"), F.col("_c.size").alias("_size"))
    same = F.col("source").eqNullSafe(F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("size") == F.col("_size"))
    joined = decided.join(written(changed, "changed_sides"), same, "left")
    return joined.select("source", "doc_id", "size", F.when(F.col("_size").isNotNull(), 1 - F.col("extra")).otherwise(F.col("extra")).alias("extra"))


def mix(docs: DataFrame, seed: int = 11, limit: int = LIMIT) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken, one row per
    row of ``docs``. The texts are read once, for their sizes; what is shuffled
    is an id and three numbers per document."""
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"))
    sizes = written(sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("_rows")), "sizes")
    wanted = targets(sizes.select("source", (F.col("size") * F.col("_rows")).alias("size")), limit=limit)
    share = F.try_divide(F.col("target"), F.col("source_size"))
    goal = wanted.select(F.col("source").alias("_of"), "source_size", "target", F.coalesce(F.floor(share), F.lit(0)).alias("_whole"), (share - F.floor(share)).alias("_part"))
    copies = F.coalesce(F.when(F.col("size") > 0, F.col("_rows") * F.col("_part")), F.lit(0.0))  # more copies that the rows of a unit should have
    planned = sizes.join(goal, F.col("source").eqNullSafe(F.col("_of")), "left").withColumn("_copies", copies).select(
        "source", "doc_id", "size", "_rows", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("_whole", F.lit(0)).alias("_whole"),
        F.floor(F.col("_copies") + 1e-9).alias("_certain"), (F.col("_copies") - F.floor(F.col("_copies") + 1e-9)).alias("_open"))
    planned = written(planned, "planned")
    units = planned.where(F.col("_open") > 1e-9).select("source", "doc_id", "size", (F.col("_open") * F.col("size")).alias("mass"))
    mass = units.groupBy("source").agg(F.sum("mass").alias("mass"))
    decided, level = [], 0
    while True:
        done = written(_round_blocks(_blocked(units, level), seed, level), f"level_{level}")
        decided.append(done.select("source", F.explode("out").alias("_d")).select("source", "_d.*"))
        units = done.select("source", "on.*")
        if not done.groupBy("source").count().where("count > 1").limit(1).count():
            break
        level += 1
    last = _uniform(F.lit(seed * 64 + 63), F.col("doc_id"), F.col("size")) * F.col("size") < F.col("mass")
    rounded = units.select("source", "doc_id", "size", last.cast("int").alias("extra"))
    for d in decided:
        rounded = rounded.unionByName(d)
    rounded = _given_back(written(rounded, "rounded"), mass, seed).where("extra = 1").select(
        F.col("source").alias("_of"), F.col("doc_id").alias("_id"), F.col("size").alias("_size"))
    same = F.col("source").eqNullSafe(F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("size") == F.col("_size"))
    counted = planned.join(written(rounded, "taken_once_more"), same, "left").select(
        "doc_id", "source", "size", "source_size", "target", "_whole", "_rows", (F.col("_certain") + F.col("_size").isNotNull().cast("long")).alias("_more"))
    # a row for each row: units of many rows in stretches that are dealt anew
    few = counted.where(F.col("_rows") <= STRETCH).withColumn("_from", F.lit(0).cast("long"))
    many = counted.where(F.col("_rows") > STRETCH).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rows") - 1, F.lit(STRETCH).cast("long"))))
    every = few.unionByName(many.repartition("doc_id", "source", "size", "_from"))
    row = F.explode(F.sequence(F.col("_from"), F.least(F.col("_rows"), F.col("_from") + STRETCH) - 1)).alias("_row")
    rows = every.select("doc_id", "source", "size", "source_size", "target", "_whole", "_more", row)
    taken = F.col("_whole") + (F.col("_row") < F.col("_more")).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("copies"), (taken * F.col("size")).cast("long").alias("taken"))


def repeat_rows(docs: DataFrame, seed: int = 11) -> DataFrame:
    """``docs`` with every row as many times as the mix takes it (0 drops it).
    Rows that share an id share the largest number taken for one of them. The
    table of copies grows with the documents, so it is joined by shuffling at every
    size, never sent whole."""
    taken = mix(docs, seed).groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.when(F.col("size") > 0, F.col("copies")).otherwise(0)).alias("_n"))
    taken = written(taken.where("_n > 0"), "copies").hint("shuffle_hash")
    out = docs.join(taken, F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))).withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return out.select(*docs.columns)
