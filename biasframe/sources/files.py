"""File sources and sinks (A1-A12). Readers take a declared schema (no
inference pass over the data); writers are plain DataFrame writers, so output
is written in parallel, one file per partition."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from biasframe.schema import SUBMISSION_SCHEMA
from biasframe.sources.splits import AT_ONCE, csv_records, json_records, pieces


def _typed(records: DataFrame, schema: T.StructType) -> DataFrame:
    """The fields of CSV records by place: an empty field is NULL, as is one that is
    no value of its type, and NaN (the reference's NaN never passes a threshold)."""
    cols = []
    for i, f in enumerate(schema.fields):
        v = F.nullif(F.get("fields", F.lit(i)), F.lit(""))
        if not isinstance(f.dataType, T.StringType):
            v = F.btrim(v).try_cast(f.dataType)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            v = F.nanvl(v, F.lit(None).cast(f.dataType))
        cols.append(v.alias(f.name))
    return records.select(*cols)


def _is_header() -> Column:
    return (F.col("start") == 0) & (F.col("seq") == 0) & (F.col("part") == 0)


def read_annotated_csv(spark: SparkSession, path: str | list[str], schema: T.StructType,
                       encoding: str = "UTF-8") -> DataFrame:
    """A1/A2: CSV with header; quoted newlines and doubled quotes are read
    as in pandas; an empty field is NULL. A file is read in many tasks, whatever
    its fields hold (``splits``)."""
    return _typed(csv_records(spark, path, encoding).where(~_is_header()), schema)


def csv_header(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> list[str]:
    """The column names of CSV files: the first record of the first file."""
    first = csv_records(spark, path, encoding).where(_is_header()).orderBy("file").limit(1).collect()
    return [n.removeprefix("\ufeff") for n in first[0].fields] if first else []


def csv_to_json(spark: SparkSession, csv_path: str, json_path: str, mode: str = "overwrite", encoding: str = "UTF-8") -> None:
    """A3: CSV -> JSON records with every value kept as a string."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in csv_header(spark, csv_path, encoding)])
    read_annotated_csv(spark, csv_path, schema, encoding).write.mode(mode).json(json_path)


def read_json_records(spark: SparkSession, path: str | list[str], schema: T.StructType, multiline: bool = True) -> DataFrame:
    """A4: JSON records: files of one array each when ``multiline``, read in many
    tasks (``splits``); else a record a line."""
    if not multiline:
        return spark.read.schema(schema).json(path)
    return json_records(spark, path).select(F.from_json("value", schema).alias("_r")).select("_r.*")


def read_json_lists(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A4: files of one array of token lists each -> tokens."""
    return json_records(spark, path, "]").select(F.from_json("value", "array<string>").alias("tokens"))


def write_json_arrays(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Each part file one JSON array, a record a line."""
    if len(df.columns) == 1 and isinstance(df.schema[0].dataType, T.ArrayType):
        rows = df.select(F.to_json(df.columns[0]).alias("value"))
    else:
        rows = df.select(F.to_json(F.struct(*df.columns)).alias("value"))

    def enclose(batches):
        opened, held = False, None
        for b in batches:
            for lo in range(0, b.num_rows, AT_ONCE):
                lines = []
                for text in b.column(0).slice(lo, AT_ONCE).to_pylist():
                    if held is not None:
                        lines.append(held + ",")
                    held, opened = ("" if opened else "[") + text, True
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array([held + "]" if opened else "[]"])], names=["value"])

    rows.mapInArrow(enclose, "value string").write.mode(mode).text(path)


def write_json(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "overwrite") -> None:
    """JSON lines; ``partition_by='tag'`` gives one folder per tag."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.json(path)


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Text lines ``word v1 ... vd`` -> (word, vector array<float>).
    A word listed twice keeps its last line (the reference's dict
    overwrite), in the order of file names, then of lines."""
    lines = pieces(spark, path, "\n").select("file", "start", "line", F.split(F.rtrim(F.col("raw").cast("string")), " ").alias("_p"))
    rows = lines.where(F.size("_p") > 1).select(
        F.struct("file", "start", "line").alias("_at"), F.element_at("_p", 1).alias("word"),
        F.slice("_p", 2, F.size("_p") - 1).cast("array<float>").alias("vector"))
    # the place of each word's last line first: the vectors of other lines aren't shuffled twice
    last = rows.groupBy("word").agg(F.max("_at").alias("_at"))
    return rows.join(last, ["word", "_at"]).select("word", "vector")


def write_word_vectors(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The inverse of ``read_word_vectors`` (for round trips and exports)."""
    (df.select(F.concat_ws(" ", F.col("word"), F.array_join(F.col("vector").cast("array<string>"), " "))
               .alias("value")).write.mode(mode).text(path))


def write_predictions(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``id,prediction`` CSV with header."""
    df.select("id", "prediction").write.mode(mode).option("header", True).csv(path)


def fill_template(template: DataFrame, predictions: DataFrame) -> DataFrame:
    """The template's ids with the predicted values, joined by id (not by
    position); ids without a prediction keep NULL."""
    return (template.select("id").join(predictions.select("id", "prediction"), "id", "left"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUBMISSION_SCHEMA).option("header", True).csv(path)


def repeated(df: DataFrame, key: str = "id") -> DataFrame:
    """A10: (key, n) of the keys that occur more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def checked_unique(df: DataFrame, key: str = "id") -> DataFrame:
    """A10: pass rows through, failing the job if a key repeats."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return df.withColumn("_n", n).withColumn(
        "_n", F.when(F.col("_n") == 1, F.col("_n")).otherwise(F.raise_error(F.concat(F.lit("duplicate id "), F.col(key).cast("string"))))
    ).drop("_n")


def republish(spark: SparkSession, in_path: str, out_path: str) -> None:
    """A10: re-read a prediction file and publish it again (ids checked)."""
    write_predictions(checked_unique(read_predictions(spark, in_path)), out_path)


def save_model(model, path: str) -> None:
    """A11."""
    model.write().overwrite().save(path)


def load_pipeline_model(path: str):
    """A11."""
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def load_model(path: str):
    """A fitted model of any kind, by the class that its metadata name."""
    from pyspark.ml.util import DefaultParamsReader
    return DefaultParamsReader.loadParamsInstance(path, SparkSession.getActiveSession())


def volume_report(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """(table, n_rows, n_columns) - one count per table, run by Spark."""
    out = None
    for name, df in frames.items():
        r = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"))
        out = r if out is None else out.unionByName(r)
    return out


def schema_report(df: DataFrame) -> list[tuple[str, str]]:
    """(column, type) pairs of a frame (metadata only, no job)."""
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
