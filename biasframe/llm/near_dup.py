"""Near-duplicate groups by b-bit MinHash (operator 8).

Each text becomes the set of its word shingles, as 64-bit hashes. Texts with
equal sets share one class. Per class, minima under many hash functions give
band keys and, by their low bits, a packed signature. Classes that share a band
are candidates: each bucket first meets its smallest member. The collision-corrected
estimate drops hopeless pairs; of the others each member's most alike is
confirmed on the full sets, then every pair that this leaves in two groups.
Links become groups by repeated label exchange. Families of candidates
that still hold several groups are then compared in chunks, the members outside
the main group with all others; links are confirmed in place, and only those
that join groups are sent on.

With the standard parameters a pair at the threshold shares no band with a
probability of 2e-6 (33 bands of five); the estimate is cut six standard deviations below it.

Defined cases: null texts, empty texts and texts without words have empty sets
and are linked with nothing; texts with fewer words than a shingle are one
shingle of all their words; ties and repeated rows are in one class; an empty
table gives an empty result; texts of any length are read whole; null ids are
never linked; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count as counter
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biasframe.llm.common import written

BANDS, ROWS, BITS = 33, 5, 8
CUT_SIGMAS = 6
CHUNK = 256
#: Long words of a packed signature, and the bytes in them that stand for no minimum.
WORDS = -(-BANDS * ROWS // 8)
PAD = WORDS * 8 - BANDS * ROWS
_U = np.uint64
_ODD = np.random.RandomState(8).randint(1, 2**63, size=(2, BANDS * ROWS), dtype=np.int64).astype(_U) | _U(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each whole text."""
    number: dict[bytes, int] = defaultdict(counter().__next__)
    coded = [np.fromiter(map(number.__getitem__, (t or "").encode("utf-8", "surrogatepass").lower().split()), np.int64) for t in texts]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, number), _U, len(number))
    out = []
    for c in coded:
        h = hashes[c] if len(c) else np.zeros(0, _U)
        n = len(h) - width + 1 if len(h) >= width else min(1, len(h))
        s = np.zeros(n, _U)
        for j in range(min(width, len(h))):
            s = mixed(s * _U(0x9E3779B97F4A7C15) + h[j:j + n])
        out.append(np.unique(s + _U(min(width, len(h)))))
    return out


def minima(s: np.ndarray) -> np.ndarray:
    """The least value of the set under each hash function, in pieces."""
    low = np.full(BANDS * ROWS, _U(2**64 - 1))
    for at in range(0, len(s), 512):  # a piece under all functions stays in the cache
        x = s[None, at:at + 512] * _ODD[0][:, None]
        x ^= x >> _U(29)
        x *= _ODD[1][:, None]
        np.minimum(low, x.min(1), out=low)
    return low


def signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, band keys, packed low bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sets = shingle_sets(part.column(1).to_pylist(), width)
                digests, bands, packed = [], [], []
                for s in sets:
                    if not len(s):
                        digests.append(None), bands.append(None), packed.append(None)
                        continue
                    m = minima(s)
                    key = np.zeros(BANDS, _U)
                    for r in range(ROWS):
                        key = mixed(key * _U(31) + m[r::ROWS])
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                    bands.append(key.view(np.int64))
                    packed.append(np.frombuffer(mixed(m).astype(np.uint8).tobytes() + bytes(PAD), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                     pa.array(bands, pa.list_(pa.int64())), pa.array(packed, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "digest", "bands", "signature"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, digest binary, bands array<long>, signature array<long>")


def least_matches(threshold: float) -> int:
    """Equal low bits needed: the corrected estimate, six deviations below."""
    k, chance = BANDS * ROWS, 2.0 ** -BITS
    p = threshold + (1 - threshold) * chance
    return max(0, int(np.floor(k * p - CUT_SIGMAS * np.sqrt(k * p * (1 - p)))))


def agreeing(a: Column, b: Column) -> Column:
    """The number of equal low bytes of two packed signatures: their words are
    XORed, the bits of every byte folded onto its lowest, and these counted."""

    def unequal(x: Column) -> Column:
        for k in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, k))
        return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))

    differ = F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda n, x: n + unequal(x))
    return F.lit(BANDS * ROWS) - differ


def groups(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, group: the least id reachable over ``links`` (a, b). Each round takes
    the least label among neighbours, then the label's own label, so labels
    travel twice as far each time. All tables are written between rounds."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = written(nodes.select("id", F.col("id").alias("group")), "labels")
    while True:
        near = both.join(label, both.b == label.id).groupBy(F.col("a").alias("_a")).agg(F.min("group").alias("_low"))
        stepped = label.join(near, F.col("id") == F.col("_a"), "left").select("id", F.col("group").alias("_old"), F.least("group", F.coalesce("_low", "group")).alias("group"))
        stepped = written(stepped, "labels")
        far = stepped.select(F.col("id").alias("_g"), F.col("group").alias("_far"))
        jumped = stepped.join(far, F.col("group") == F.col("_g"), "left").select("id", "_old", F.least("group", F.coalesce("_far", "group")).alias("group"))
        jumped = written(jumped, "labels")
        moved = jumped.where("`group` <> _old").limit(1).count()
        label = jumped.select("id", "group")
        if not moved:
            return label


def bloom(id_: Column, words: Column) -> tuple[Column, Column]:
    """The word of a blocked Bloom filter that an id falls into, and its three bits."""
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(id_, F.lit(k)), F.lit(64)).cast("int")) for k in (1, 2, 3)]
    return F.pmod(F.xxhash64(id_), words), bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, text: one whole text of each document whose id is in ``ids`` (distinct).

    A Bloom filter of two bytes an id, a written table that the planner
    broadcasts if it is small enough, leaves other texts out of the shuffle; its
    false hits go in the join that follows."""
    ids = written(ids, "text_ids")
    words = F.lit(max(1, ids.count() // 4)).cast("long")
    word, bits = bloom(F.col("id"), words)
    sieve = written(ids.groupBy(word.alias("word")).agg(F.bit_or(bits).alias("bits")), "text_sieve")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    texts = texts.join(sieve, (word == F.col("word")) & (F.col("bits").bitwiseAND(bits) == bits), "left_semi")
    return texts.join(ids, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))


def ends(pairs: DataFrame) -> DataFrame:
    """id: every id that occurs in a pair (a, b)."""
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets pass the threshold.

    Rows are dealt by (a, chunk of its partners) and sorted so that the text of
    ``a`` comes first: a task holds one set of it and streams the others past.
    The partners of a much-used ``a`` are spread over many chunks."""
    chunks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    dealt = pairs.join(chunks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"))
    heads = chunks.select(F.col("a").alias("id"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    heads = heads.join(texts, "id").select(F.col("id").alias("a"), "chunk", F.lit(None).cast("long").alias("b"), "text")
    rest = dealt.withColumnRenamed("b", "id").join(texts, "id").select("a", "chunk", F.col("id").alias("b"), "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.zeros(0, _U)
        for b in batches:
            left, right = [], []
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = shingle_sets(part.column(2).to_pylist(), width)
                for x, y, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), sets):
                    if y is None:
                        first = s
                        continue
                    same = len(np.intersect1d(first, s, assume_unique=True))
                    if 100 * same >= percent * (len(first) + len(s) - same):
                        left.append(x), right.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    streams = heads.unionByName(rest).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    return written(streams.select("a", "b", "text").mapInArrow(check, "a long, b long"), "confirmed")


def with_sets(members: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``members`` and full: the sorted shingle hashes of their whole texts."""
    both = members.join(texts, "id")
    columns, at = members.columns, both.columns.index("text")
    places = [both.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                sets = shingle_sets(part.column(at).to_pylist(), width)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in places], pa.array([s.tobytes() for s in sets], pa.binary())],
                                                 names=[*columns, "full"])

    return both.mapInArrow(run, T.StructType([*[members.schema[c] for c in columns], T.StructField("full", T.BinaryType())]))


def _links_between(least: int, percent: int):
    """Links between the groups of two chunks, confirmed on the full sets in
    place: of all links only those that join two groups not yet joined here, so
    a unit sends on fewer rows than it has members, however many pairs pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for unit in pdf.to_dict("records"):
                x, y = unit["left"], unit["right"]
                ids, number = np.array([m["id"] for m in y]), {}
                group = np.array([number.setdefault(m["group"], len(number)) for m in y])
                signs = np.stack([np.asarray(m["signature"], np.int64) for m in y]).view(np.uint8)
                sets = [np.frombuffer(m["full"], _U) for m in y]
                size = np.array([len(s) for s in sets])
                for m in x:
                    own = number.setdefault(m["group"], len(number))
                    agree = np.count_nonzero(signs == np.asarray(m["signature"], np.int64).view(np.uint8), axis=1) - PAD >= least
                    full = np.frombuffer(m["full"], _U)
                    for g in np.unique(group[agree & (group != own)]):
                        at = np.flatnonzero(agree & (group == g))
                        every = np.concatenate([sets[k] for k in at])
                        place = np.minimum(np.searchsorted(full, every), len(full) - 1)
                        same = np.add.reduceat((full[place] == every).astype(np.int64), np.cumsum(size[at]) - size[at])
                        hit = np.flatnonzero(100 * same >= percent * (len(full) + size[at] - same))
                        if len(hit):
                            other = int(ids[at[hit[0]]])
                            yield pd.DataFrame({"a": [min(m["id"], other)], "b": [max(m["id"], other)]})
                            group[group == g] = own
                            number = {k: own if v == g else v for k, v in number.items()}

    return run


def merged(label: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """id, group after the groups that ``links`` (a, b: ids) joins become one.
    Only the links between different groups are followed."""
    for end in ("a", "b"):
        links = links.join(label.withColumnsRenamed({"id": end, "group": f"_{end}"}), end)
    between = written(links.where("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(), "between")
    if not between.limit(1).count():
        return label
    up = groups(between, ends(between)).select(F.col("group").alias("_new"), F.col("id").alias("group"))
    return written(label.join(up, "group", "left").select("id", F.coalesce("_new", "group").alias("group")), name)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    least = least_matches(percent / 100)
    made = written(signed(docs, width), "signatures")
    classes = made.where("digest is not null and doc_id is not null").groupBy("digest").agg(
        F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    classes = written(classes, "classes")
    nodes, signature = classes.select("id"), classes.select("id", "signature")
    members = classes.select("id", F.posexplode("bands").alias("band", "key"))
    buckets = members.groupBy("band", "key").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = written(buckets.select("band", "key", "pivot"), "buckets")
    bucketed = written(members.join(buckets, ["band", "key"]).where("pivot <> id"), "bucketed")
    # every bucket meets its least member: one pair per member, whatever its size
    star = bucketed.select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    star = star.join(signature.withColumnsRenamed({"id": "a", "signature": "sa"}), "a").join(signature.withColumnsRenamed({"id": "b", "signature": "sb"}), "b")
    agree = agreeing(F.col("sa"), F.col("sb"))
    star = written(star.select("a", "b", agree.alias("agree"), (agree >= least).alias("near")), "star_pairs")
    tested = star.where("near").select("a", "b")
    # families: what may still be linked. Members near their pivot belong to it;
    # members of a bucket that are not may be near each other, and stay together
    far = bucketed.join(star.where("not near").select(F.col("a").alias("pivot"), F.col("b").alias("id")), ["pivot", "id"])
    second = far.groupBy("band", "key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    loose = far.join(second, ["band", "key"]).where("a <> id").select("a", F.col("id").alias("b"))
    related = written(tested.unionByName(loose).distinct(), "family_links")
    texts = written(texts_of(docs, ends(related)), "texts")
    # the most alike partner of each first; then those pairs that are still in two groups
    best = star.where("near").groupBy("b").agg(F.max_by("a", F.struct("agree", -F.col("a"))).alias("a")).select("a", "b")
    label = merged(nodes.select("id", F.col("id").alias("group")), confirmed(best, texts, width, percent), "first_groups")
    apart = tested.join(best, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        apart = apart.join(label.withColumnsRenamed({"id": end, "group": f"g{end}"}), end)
    apart = written(apart.where("ga <> gb").select("a", "b"), "pairs_apart")
    label = merged(label, confirmed(apart, texts, width, percent), "star_groups")
    family = merged(label, related, "families")
    family = family.withColumnRenamed("group", "family").join(label, "id")
    mixed_families = family.groupBy("family").agg(F.min("group").alias("_low"), F.max("group").alias("_high"), F.min("id").alias("_first"),
                                                  F.count(F.lit(1)).alias("_n")).where("_low <> _high")
    largest = family.groupBy("family", "group").agg(F.count(F.lit(1)).alias("_m")).groupBy("family").agg(F.max_by("group", F.struct("_m", "group")).alias("main"))
    open_ = family.join(mixed_families.select("family", F.ceil(F.col("_n") / CHUNK).cast("int").alias("chunks")), "family").join(largest, "family")
    open_ = written(open_, "open_members")
    if open_.limit(1).count():
        whole = open_.join(signature, "id").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
        member = F.struct("id", "group", "signature", "full")
        whole = written(with_sets(whole, texts, width), "family_members")
        right = whole.groupBy("family", "chunk").agg(F.collect_list(member).alias("right"))
        left = whole.where(F.col("group") != F.col("main")).groupBy("family", "chunks", "chunk").agg(F.collect_list(member).alias("left"))
        left = left.select("family", "left", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        units = left.join(right, ["family", "chunk"]).select("left", "right")
        more = written(units.mapInPandas(_links_between(least, percent), "a long, b long").distinct(), "other_links")
        label = merged(label, more, "all_groups")
    by_set = classes.select("digest", "id").join(label, "id").select("digest", F.col("group").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return made.select("doc_id", "n_shingles", "digest").join(by_set, "digest", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group (the one with the least id; if
    rows repeat it, each of them that has that id)."""
    gone = near_duplicates(docs, width, percent).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    gone = written(gone, "dropped_ids")
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
