"""WARC archives, written and read back by boundary-chain verification (operator 9).

Archives are plain text files of records, so Spark reads one file in many
splits, cut at the record magic. A magic may also stand inside a payload: each
cut is only a candidate. A candidate's header says where its successor starts;
stretches of candidates that follow one another are joined per split, and
pointer jumping over the stretches from the start of each file keeps exactly
the candidates that the chain reaches.

Defined cases: a null payload is empty; null ids and addresses are written as
empty and read as null; equal payloads (empty ones too) share one response, the
one with the largest id, repeated rows of that id included; payloads of any
content and length are kept whole; an empty table gives no records; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from biasframe.llm.common import scratch, written

MAGIC = "WARC/1.0\r\n"
GAP = "\r\n\r\n"
RECORDS_PER_FILE = 50_000
#: The digits of base 32, and those that conv() writes.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: every five hexadecimal digits are four."""
    h = F.sha1(payload)
    fours = [F.lpad(F.conv(F.substring(h, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*fours), CONV32, BASE32)


def plan_revisits(pages: DataFrame) -> DataFrame:
    """page_id, digest, refers_to of the pages that repeat another's payload."""
    html = F.coalesce("html", F.lit(""))
    known = written(pages.select(F.col("page_id").cast("long").alias("page_id"), base32_sha1(html).alias("digest")), "digests")
    groups = known.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = known.join(groups, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return written(again.distinct(), "revisits")


def write_archives(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """One record per row of ``pages``. The payloads are not shuffled unless
    repeats are so many that their table is too large to broadcast."""
    again = plan_revisits(pages).withColumnsRenamed({"page_id": "_id", "digest": "_digest"})
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), base32_sha1(html).alias("digest"))
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    revisit = F.col("_digest").isNotNull()
    address = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    block = F.concat(F.lit(HTTP_HEAD), F.octet_length("html").cast("string"), F.lit(GAP), F.when(revisit, F.lit("")).otherwise(F.col("html")))
    rows = rows.withColumn("block", block)
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")), F.lit("\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nWARC-Target-URI: "), address,
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name(F.col("refers_to")))).otherwise(F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("block").cast("string"), F.lit(GAP))
    (rows.select(F.concat(head, F.col("block")).alias("value"))
         .write.option("lineSep", GAP).option("maxRecordsPerFile", records_per_file).text(path))


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """What stands between two magics: file, split, order in it, value."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                      F.monotonically_increasing_id().alias("order"), "value", F.octet_length("value").cast("long").alias("length"))


def _with_offsets(chunks: DataFrame) -> DataFrame:
    """``off``: where the magic before a chunk starts (below 0: there is none);
    ``ends``: where the next one does. Sums within splits, then over splits."""
    step = F.col("length") + len(MAGIC)
    within = Window.partitionBy("file", "split").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    sums = written(chunks.groupBy("file", "split").agg(F.sum(step).alias("_sum")), "split_sums")
    over = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    base = written(sums.select("file", "split", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_base")), "split_offsets")
    placed = chunks.withColumn("_in", F.coalesce(F.sum(step).over(within), F.lit(0))).join(base, ["file", "split"])
    return placed.withColumn("off", F.col("_base") + F.col("_in") - len(MAGIC)).withColumn("ends", F.col("off") + step).where("off >= 0")


def _header(value: Column) -> Column:
    return F.substring_index(value, GAP, 1)


def _field(head: Column, name: str) -> Column:
    got = F.regexp_extract(head, rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
    return F.when(got != "", got)


def _number(text: Column) -> Column:
    return F.regexp_extract(text, r"(-?\d{1,19})", 1).try_cast("long")


def _parsed(head: Column) -> list[Column]:
    return [_field(head, "WARC-Type").alias("type"), _number(_field(head, "WARC-Record-ID")).alias("page_id"),
            _number(_field(head, "WARC-Refers-To")).alias("refers_to"), _field(head, "WARC-Payload-Digest").alias("stated")]


def _content(block: Column) -> list[Column]:
    """From the bytes of a block: the stated length, and the payload's own."""
    http = F.substring_index(block.cast("string"), GAP, 1)
    payload = block.substr(F.octet_length(http) + len(GAP) + 1, F.lit(2**31 - 1))
    return [_number(_field(http, "Content-Length")).alias("http_length"), F.octet_length(payload).cast("long").alias("payload_length"),
            base32_sha1(payload).alias("computed")]


def reached(candidates: DataFrame) -> DataFrame:
    """The candidates (file, split, off, ends, succ) on the chain from offset 0.

    A stretch is a run of candidates of one split, each the successor of the one
    before. Its last one says where the chain goes on. The doubling rounds work
    on stretches: about one per split, and one more per false magic."""
    w = Window.partitionBy("file", "split").orderBy("off")
    opens = F.coalesce(F.lag("succ").over(w) != F.col("off"), F.lit(True)) | F.lag("succ").over(w).isNull()
    marked = candidates.withColumn("stretch", F.max(F.when(opens, F.col("off"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    marked = written(marked, "stretches")
    lasts = marked.groupBy("file", "stretch").agg(F.max_by("succ", "off").alias("goes"))
    ways = marked.select("file", F.col("off").alias("goes"), F.col("stretch").alias("to"))
    jump = written(lasts.join(ways, ["file", "goes"]).where("goes > stretch").select("file", "stretch", "to", F.col("goes").alias("entry")), "jumps")
    there = written(marked.where("off = 0").select("file", "stretch", F.lit(0).cast("long").alias("entry")), "reached")
    known = there.count()
    while True:
        on = there.join(jump.withColumnRenamed("entry", "_at"), ["file", "stretch"]).select("file", F.col("to").alias("stretch"), F.col("_at").alias("entry"))
        there = written(there.unionByName(on).distinct(), "reached")
        now = there.count()
        if now == known:
            break
        known = now
        further = jump.select("file", F.col("stretch").alias("to"), F.col("to").alias("_to"), F.col("entry").alias("_entry"))
        jump = written(jump.drop("entry").join(further, ["file", "to"]).select("file", "stretch", F.col("_to").alias("to"), F.col("_entry").alias("entry")), "jumps")
    return marked.join(there, ["file", "stretch"]).where("off >= entry")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, type, refers_to, payload_bytes and payload_digest of every
    record that the chain reaches in the archives below ``path``."""
    chunks = _chunks(spark, path)
    head = _header(F.col("value"))
    sized = chunks.withColumn("_h", head).withColumns({"_at": F.octet_length("_h").cast("long") + len(GAP), "_n": _number(_field(F.col("_h"), "Content-Length"))})
    whole = F.col("_at") + F.col("_n") + len(GAP) == F.col("length")
    block = F.when(whole, F.col("value").cast("binary").substr(F.col("_at").cast("int") + 1, F.col("_n").cast("int")))
    small = sized.withColumn("_b", block).select("file", "split", "order", "length", "_at", "_n", whole.alias("whole"), *_parsed(F.col("_h")), *_content(F.col("_b")))
    placed = _with_offsets(written(small, "candidates")).withColumn("succ", F.col("off") + len(MAGIC) + F.col("_at") + F.col("_n") + len(GAP))
    good = written(reached(placed.drop("order", "_in", "_base")), "records")
    closed = good.where("whole")
    cut = written(good.where("not whole and succ is not null"), "cut_records")
    rows = closed.select("page_id", "type", "refers_to", "stated", "http_length", "payload_length", "computed")
    if cut.limit(1).count():  # magics inside payloads: put those records together again
        files = cut.select("file").distinct()
        parts = _with_offsets(chunks.join(files, "file", "left_semi"))
        marks = good.select("file", "off", F.struct(F.col("off").alias("at"), "succ", "_at", "_n", "whole").alias("mark"))
        marked = parts.select("file", "off").join(marks, ["file", "off"], "left")
        of = F.last("mark", ignorenulls=True).over(Window.partitionBy("file").orderBy("off").rowsBetween(Window.unboundedPreceding, 0))
        owner = marked.withColumn("of", of).where("of is not null and not of.whole and off < of.succ")  # a file's offsets, without the texts
        owned = parts.select("file", "off", "value").join(owner, ["file", "off"])
        joined = owned.groupBy("file", F.col("of.at").alias("off"), F.col("of._at").alias("_at"), F.col("of._n").alias("_n")).agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("off", "value"))), lambda p: p["value"]), MAGIC).alias("value"))
        body = joined.where(F.octet_length("value") >= F.col("_at") + F.col("_n")).withColumn(
            "_b", F.col("value").cast("binary").substr(F.col("_at").cast("int") + 1, F.col("_n").cast("int")))
        more = body.select(*_parsed(_header(F.col("value"))), *_content(F.col("_b")))
        rows = rows.unionByName(more.select(*rows.columns))
    revisit = F.col("type") == "revisit"
    return rows.where(F.col("type").isin("response", "revisit")).select(
        "page_id", F.when(revisit, F.col("http_length")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(revisit, F.substring_index("stated", ":", -1)).otherwise(F.col("computed")).alias("payload_digest"),
        F.col("type").alias("record_type"), F.when(revisit, F.col("refers_to")).alias("refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives of ``pages`` to the shared folder, and read them back."""
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)


WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS best FROM p)
SELECT page_id, payload_bytes,
       translate({' || '.join(f"lpad(to_base(('0x' || substr(x, {1 + 5 * i}, 5))::BIGINT, 32), 4, '0')" for i in range(8))},
                 '{CONV32}', '{BASE32}') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to
FROM d
"""
