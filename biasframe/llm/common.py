"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from biasframe.session import checkpoint_dir

#: The six ASCII white-space characters that separate words.
WORD_GAP = " \t\n\x0b\x0c\r"
WORD_GAP_PATTERN = r"[\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder named by ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts
    lineage, survives lost executors, and gives the planner true table sizes,
    so that a later join broadcasts this table only if it is really small."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_memory() -> None:
    """Give memory that is free in this worker process, which lives on after a
    task, back to the machine (where the C library can)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Bytes of text that ``append_columns`` turns into Python values at once.
SLICE_BYTES = 4 << 20


def slices(b: pa.RecordBatch, places: Sequence[int], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Stretches of a batch whose texts (the columns at ``places``) have about
    ``limit`` bytes; a longer text is alone or last."""
    size = np.ones(b.num_rows, np.int64)
    for i in places:
        if pa.types.is_string(b.column(i).type) or pa.types.is_large_string(b.column(i).type):
            size += pc.fill_null(pc.binary_length(b.column(i)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(size) - size) // limit
    cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, b.num_rows]
    for lo, hi in zip(cuts.tolist(), cuts[1:].tolist()):
        yield b.slice(lo, hi - lo)


def append_columns(df: DataFrame, inputs: Sequence[str], fields: Sequence[T.StructField],
                   make: Callable[[], Callable[..., Sequence]]) -> DataFrame:
    """``df`` with ``fields`` computed batch by batch in Python, no shuffle.

    ``make()`` runs once per task and returns a function that maps the input
    columns (Python lists) to one list or array per field; it is called for
    stretches of some MB of text, so memory is bounded whatever the batch. A
    column of ``df`` that has the name of a new field is replaced by it."""
    new = {f.name for f in fields}
    kept = [c for c in df.columns if c not in new]
    schema = T.StructType([*[df.schema[c] for c in kept], *fields])
    types = [to_arrow_type(f.dataType) for f in fields]
    places = [df.columns.index(c) for c in inputs]
    passed = [df.columns.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for b in slices(batch, places) if batch.num_rows else [batch]:
                made = fn(*[b.column(i).to_pylist() for i in places])
                cols = [b.column(i) for i in passed] + [pa.array(v, type=t, from_pandas=True) for v, t in zip(made, types)]
                del made
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)
                del b, cols
        release_memory()

    return df.mapInArrow(run, schema)


def word_array(text: Column) -> Column:
    """The words of a text, [] for null and blank texts."""
    body = F.btrim(text, F.lit(WORD_GAP))
    return F.when(F.length(body) > 0, F.split(body, WORD_GAP_PATTERN)).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    body = F.btrim(text, F.lit(WORD_GAP))
    return F.when(F.length(body) > 0, F.size(F.split(body, WORD_GAP_PATTERN))).otherwise(F.lit(0)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids count as remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))
