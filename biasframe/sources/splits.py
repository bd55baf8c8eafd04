"""Records of one large file read in many splits.

A quoted CSV field may hold newlines, and a JSON array is often one line, so a
reader that starts in the middle of a file doesn't know whether it stands inside
a record. The files are read as pieces between one separator (a newline, or
the bracket that ends a record), which Spark's text source splits at any byte. A
small automaton says, for a piece and each mode it may start in, the mode and the
change of depth at its end. Such steps compose, so

1. every split folds its pieces into one step (a row per split),
2. a scan over the splits of a file gives each one its true start, and
3. every split, now knowing where it starts, cuts its records; what stands
   before its first and after its last record end goes on as a fragment, and
   the fragments (at most two a split) are joined across splits.

No text is shuffled but the fragments. Files in compressed form without splits
are one split each.
"""

from __future__ import annotations

import csv
import io
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from biasframe.session import checkpoint_dir

#: Splits whose starts are sent to every task (some 100 bytes each); beyond, they are joined.
MOST_SENT = 100_000
#: Bytes of records that leave a task in one batch, and pieces that become Python values at once.
BATCH_BYTES, AT_ONCE = 4 << 20, 128
WHOLE, HEAD, TAIL, MIDDLE = 0, 1, 2, 3


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder named by ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}/{name}"


class QuotedLines:
    """Lines of a CSV file. Mode 1 is inside a quoted field. A quote opens a field
    only at its start; a doubled one is a quote; what follows a closing quote up
    to the delimiter is plain text."""

    separator, closing, modes = "\n", b"", 2

    def __init__(self, delimiter: str = ",", quote: str = '"'):
        self.delimiter, self.quote = delimiter.encode(), quote.encode()
        self.before = (self.delimiter, b"\r")

    def step(self, line: bytes, mode: int) -> tuple[int, int]:
        at, quote = 0, self.quote
        while True:
            if mode == 0:  # at the start of a field
                at = line.find(quote, at) if at >= 0 else -1
                if at < 0:
                    return 0, 0
                if at and line[at - 1:at] not in self.before:  # a quote inside a plain field
                    at = self._next_field(line, at)
                    continue
                at += 1
            while True:
                end = line.find(quote, at)
                if end < 0:
                    return 1, 0
                if line[end + 1:end + 2] != quote:
                    break
                at = end + 2
            mode, at = 0, self._next_field(line, end + 1)

    def _next_field(self, line: bytes, at: int) -> int:
        ends = [e for e in (line.find(b, at) for b in self.before) if e >= 0]
        return min(ends) + 1 if ends else -1

    @staticmethod
    def between(mode: int, depth: int) -> bool:
        """Is this the place between two records?"""
        return mode == 0

    ended = between


class JsonArray:
    """Pieces of a file that holds one array, each up to a closing bracket. Mode 1
    is inside a string, mode 2 there behind a backslash. A record ends
    where its bracket leads back to depth 1, that of the outer array."""

    modes = 3
    _string = re.compile(rb'"(?:[^"\\]|\\.)*+"', re.DOTALL)
    _rest = re.compile(rb'(?:[^"\\]|\\.)*+"', re.DOTALL)

    def __init__(self, closing: str = "}"):
        self.separator, self.closing = closing, closing.encode()

    def step(self, piece: bytes, mode: int) -> tuple[int, int]:
        text = piece + self.closing
        if mode:
            at = 1 if mode == 2 else 0
            rest = self._rest.match(text, at)
            if rest is None:
                return self._open(text[at:]), 0
            text = text[rest.end():]
        bare = self._string.sub(b"", text)
        cut = bare.find(b'"')
        end = 0
        if cut >= 0:
            end, bare = self._open(bare[cut + 1:]), bare[:cut]
        return end, bare.count(b"{") + bare.count(b"[") - bare.count(b"}") - bare.count(b"]")

    @staticmethod
    def _open(text: bytes) -> int:
        """The mode behind the text of an open string."""
        return 2 if (len(text) - len(text.rstrip(b"\\"))) % 2 else 1

    @staticmethod
    def between(mode: int, depth: int) -> bool:
        return mode == 0 and depth <= 1

    @staticmethod
    def ended(mode: int, depth: int) -> bool:
        return mode == 0 and depth == 1


def pieces(spark: SparkSession, path: str | list[str], separator: str) -> DataFrame:
    """file, start (of the split), line (ascending within a split), raw."""
    read = spark.read.option("lineSep", separator).text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                       F.monotonically_increasing_id().alias("line"), F.col("value").cast("binary").alias("raw"))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[bytes]]]:
    """((file, start, further columns), pieces) for stretches of one split each."""
    for batch in batches:
        for lo in range(0, batch.num_rows, AT_ONCE):
            b = batch.slice(lo, AT_ONCE)
            columns = [b.column(i) for i in range(b.num_columns)]
            keys, raw = [c.to_pylist() for c in columns[:-1]], columns[-1].to_pylist()
            at = 0
            for k in range(1, b.num_rows + 1):
                if k == b.num_rows or keys[1][k] != keys[1][at] or keys[0][k] != keys[0][at]:
                    yield tuple(c[at] for c in keys), raw[at:k]
                    at = k


def split_starts(lines: DataFrame, grammar) -> DataFrame:
    """file, start, mode, depth: the state in which each split begins."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mode, depth = None, [], []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int64()), pa.array([mode], pa.list_(pa.int32())),
                                               pa.array([depth], pa.list_(pa.int64()))], names=["file", "start", "mode", "depth"])

        for key, raw in _by_split(batches):
            if key != now:
                if now is not None:
                    yield row()
                now, mode, depth = key, list(range(grammar.modes)), [0] * grammar.modes
            for piece in raw:
                steps = {m: grammar.step(piece, m) for m in set(mode)}  # modes soon fall together
                depth = [d + steps[m][1] for d, m in zip(depth, mode)]
                mode = [steps[m][0] for m in mode]
        if now is not None:
            yield row()

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")
        mode, depth, states = 0, 0, []
        for modes, depths in zip(pdf["mode"], pdf["depth"]):
            states.append((mode, depth))
            mode, depth = int(modes[mode]), depth + int(depths[mode])
        return pd.DataFrame({"file": pdf["file"], "start": pdf["start"], "mode": [m for m, _ in states], "depth": [d for _, d in states]})

    folded = lines.select("file", "start", "raw").mapInArrow(fold, "file string, start long, mode array<int>, depth array<long>")
    return folded.groupBy("file").applyInPandas(scan, "file string, start long, mode int, depth long")  # a row per split


def records(spark: SparkSession, path: str | list[str], grammar, finish: Callable[[list[bytes]], list], kind: T.DataType) -> DataFrame:
    """file, start, seq (the record's place: its split and its number there) and
    ``value`` = ``finish`` of the texts, of type ``kind``. ``finish`` gives one
    value per text, None to drop it."""
    lines = pieces(spark, path, grammar.separator)
    where = scratch(spark, "split_starts")
    split_starts(lines, grammar).write.parquet(where)
    starts = spark.read.parquet(where)
    known = starts.limit(MOST_SENT + 1).collect()
    sent = None
    if len(known) <= MOST_SENT:
        sent = spark.sparkContext.broadcast({(r.file, r.start): (r.mode, r.depth) for r in known})
        given = lines.select("file", "start", "raw")
    else:
        given = lines.join(starts, ["file", "start"]).sortWithinPartitions("file", "start", "line").select("file", "start", "mode", "depth", "raw")
    value_type, separator = to_arrow_type(kind), grammar.separator.encode()
    names = ["file", "start", "seq", "kind", "fragment", "value"]

    def rows(file: str, start: int, seq: list[int], what: list[int], fragment: list, value: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([file] * len(seq), pa.string()), pa.array([start] * len(seq), pa.int64()), pa.array(seq, pa.int64()),
                                           pa.array(what, pa.int32()), pa.array(fragment, pa.binary()), pa.array(value, value_type)], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, whole, size = None, [], [], 0
        mode = depth = seq = 0
        open_ = False  # does the text so far go on from another split?

        def whole_rows() -> Iterator[pa.RecordBatch]:
            nonlocal whole, size
            if whole:
                value = finish([t for _, t in whole])
                yield rows(now[0], now[1], [s for s, _ in whole], [WHOLE] * len(whole), [None] * len(whole), value)
            whole, size = [], 0

        def last_rows() -> Iterator[pa.RecordBatch]:
            yield from whole_rows()
            if parts:
                yield rows(now[0], now[1], [seq], [MIDDLE if open_ else TAIL], [separator.join(parts)], [None])

        for key, raw in _by_split(batches):
            if key[:2] != now:
                if now is not None:
                    yield from last_rows()
                now, parts, seq = key[:2], [], 0
                mode, depth = key[2:] if sent is None else sent.value[now]
                open_ = not grammar.between(mode, depth)
            for piece in raw:
                parts.append(piece)
                mode, change = grammar.step(piece, mode)
                depth += change
                if grammar.ended(mode, depth):
                    text = separator.join(parts) + grammar.closing
                    if open_:
                        yield rows(now[0], now[1], [seq], [HEAD], [text], [None])
                    else:
                        whole.append((seq, text))
                        size += len(text)
                        if size >= BATCH_BYTES:
                            yield from whole_rows()
                    parts, open_, seq = [], False, seq + 1
        if now is not None:
            yield from last_rows()

    made = T.StructType([T.StructField("file", T.StringType()), T.StructField("start", T.LongType()), T.StructField("seq", T.LongType()),
                         T.StructField("kind", T.IntegerType()), T.StructField("fragment", T.BinaryType()), T.StructField("value", kind)])
    every = given.mapInArrow(cut, made)
    # fragments of one record: those from a tail on, up to the next tail
    order = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    broken = every.where(F.col("kind") != WHOLE).select("file", "start", "seq", "kind", "fragment")
    number = broken.select("file", "start", "kind", F.count_if(F.col("kind") == TAIL).over(order).alias("record"))
    joined = broken.join(number, ["file", "start", "kind"]).groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "seq", "fragment"))).alias("_f"))
    joined = joined.select("file", F.col("_f")[0]["start"].alias("start"), F.col("_f")[0]["seq"].alias("seq"), F.transform("_f", lambda f: f["fragment"]).alias("_t"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, AT_ONCE):
                some = b.slice(lo, AT_ONCE)
                value = finish([separator.join(t) for t in some.column(3).to_pylist()])
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), pa.array(value, value_type)], names=["file", "start", "seq", "value"])

    ends = joined.mapInArrow(join, T.StructType([made["file"], made["start"], made["seq"], made["value"]]))
    return every.where(F.col("kind") == WHOLE).select("file", "start", "seq", "value").unionByName(ends).where(F.col("value").isNotNull())


def csv_records(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", delimiter: str = ",", quote: str = '"') -> DataFrame:
    """file, start, seq, part, fields array<string>: every record in file order
    (start, seq, part), blank lines left out. Lone carriage returns end records as
    newlines do. For encodings in which ASCII characters are single bytes."""
    if any(c.encode(encoding) != c.encode("ascii") for c in ("\n", delimiter, quote)):
        raise ValueError(f"{encoding} cannot be split at bytes")

    def finish(texts: list[bytes]) -> list[list[list[str]] | None]:
        csv.field_size_limit(2**31 - 1)
        return [[r for r in csv.reader(io.StringIO(t.decode(encoding, "replace"), newline=""), delimiter=delimiter, quotechar=quote) if r] or None
                for t in texts]

    every = records(spark, path, QuotedLines(delimiter, quote), finish, T.ArrayType(T.ArrayType(T.StringType())))
    return every.select("file", "start", "seq", F.posexplode("value").alias("part", "fields"))


def json_records(spark: SparkSession, path: str | list[str], closing: str = "}") -> DataFrame:
    """file, start, seq, value: the text of every record of files that hold an array
    of objects each, or with ``closing`` = "]" an array of arrays."""
    grammar, last = JsonArray(closing), closing.encode()
    between = re.compile(rb"(?:\xef\xbb\xbf)?[\s,]*")
    nothing = re.compile(rb"[\[\],\s]*\Z")

    def finish(texts: list[bytes]) -> list[str | None]:
        out = []
        for t in texts:
            t = t[between.match(t).end():]
            if not t.endswith(last) and nothing.match(t):  # behind the last record
                out.append(None)
                continue
            if grammar.step(t.removesuffix(last), 0)[1] == 1:  # the bracket of the outer array
                t = t[1:].lstrip()
            out.append(t.decode("utf-8", "replace"))
        return out

    return records(spark, path, grammar, finish, T.StringType())
