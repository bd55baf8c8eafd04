"""Structured Streaming form of the stateless row operators.

The reference has no stream. Cleaning (D), text features (E) and model
scoring (L5) are row-wise, so the batch operators run unchanged on a
``readStream`` source; this module only wires source, sink and checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biasframe.functions.text import clean
from biasframe.operators.features import add_features
from biasframe.session import checkpoint_dir


def prepare(stream: DataFrame, text: str = "comment_text", model=None) -> DataFrame:
    """Clean the text, add the 30 features and (optionally) score rows."""
    out = add_features(stream.withColumn("clean_text", clean(F.col(text))), text, as_array="features_array")
    if model is not None:
        from biasframe.operators.models import score, with_vector
        out = score(model, with_vector(out, "features_array"))
    return out


def start(spark: SparkSession, source_dir: str, schema: T.StructType, sink_dir: str,
          name: str = "comments_scoring", text: str = "comment_text", model=None,
          source_format: str = "parquet", available_now: bool = True):
    """Run ``prepare`` from a file source into a parquet sink. The streaming
    checkpoint lives under the shared ``spark.checkpoint.dir``, so a restarted
    driver or a lost executor resumes where it stopped."""
    src = spark.readStream.schema(schema).format(source_format).load(source_dir)
    out = prepare(src, text, model)
    w = (out.writeStream.format("parquet").option("path", sink_dir)
            .option("checkpointLocation", f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}")
            .queryName(name))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
