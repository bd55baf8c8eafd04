"""Quoted CSV files and JSON arrays read in many small splits, against pandas,
Python's csv module and json.load."""

import csv
import io
import json
import os
import random
import tempfile

import pandas as pd
import pytest
from pyspark.sql import types as T

from biasframe.sources import files, splits

TEXT = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "comment_text", "note")])
CELLS = ["", "plain", 'say "hi"', "two\nlines", "a,b", '"', '""', "\n", "x\r\ny", 'end"', ",", "é世🙂", '"\n"', "a\n\nb", " lead", '","', "{}[]\\"]


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="biasframe-test-", dir="/tmp")


@pytest.fixture()
def small_splits(spark):
    """Splits of about ``n`` bytes, so that a record spans several of them."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")

    def use(n):
        spark.conf.set(keys[0], n)
        spark.conf.set(keys[1], "1")
        spark.conf.set(keys[2], "1")

    yield use
    for k in keys:
        spark.conf.unset(k)


def cells(n, seed):
    rnd = random.Random(seed)
    return [[str(i), "".join(rnd.choices(CELLS, k=rnd.randint(1, 5))), rnd.choice(CELLS)] for i in range(n)]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("size, sent", [(7, True), (64, True), (64, False), (100000, True)])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_equals_the_csv_module(spark, folder, small_splits, size, sent, end, monkeypatch):
    if not sent:
        monkeypatch.setattr(splits, "MOST_SENT", 0)
    want = []
    for k in range(2):
        data = cells(40, k)
        data[3][1] = "long\n" * 60  # a record over many splits
        with open(os.path.join(folder, f"part{k}.csv"), "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f, lineterminator=end)
            w.writerow(["id", "comment_text", "note"])
            w.writerows(data)
            f.write(end + '900,mid"quote,5" pipe, "x""' + end + end)  # stray quotes inside plain fields, blank lines
        with open(os.path.join(folder, f"part{k}.csv"), newline="", encoding="utf-8") as f:
            want += [tuple(v or None for v in r) for r in list(csv.reader(f))[1:] if r]
    small_splits(size)
    got = files.read_annotated_csv(spark, folder, TEXT)
    assert rows_of(got.na.fill("")) == sorted(tuple((v or "") for v in r[:3]) for r in want)
    if size < 1000:
        assert splits.pieces(spark, folder, "\n").select("start").distinct().count() > 20


def test_csv_types_latin1_and_order(spark, folder, small_splits):
    small_splits(9)
    text = 'id,target,comment_text\n1,0.5,"line one\nligne été"\n2,,"say ""hi"""\n3,NaN,\nx,1e-3,\xff\n5, 2 ,""\n'
    path = os.path.join(folder, "train.csv")
    with open(path, "wb") as f:
        f.write(text.encode("latin-1"))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("comment_text", T.StringType())])
    got = [tuple(r) for r in files.read_annotated_csv(spark, path, schema, "latin-1").collect()]
    want = pd.read_csv(io.BytesIO(text.encode("latin-1")), encoding="latin-1")
    assert sorted(got, key=repr) == sorted([(1, 0.5, "line one\nligne été"), (2, None, 'say "hi"'), (3, None, None), (None, 0.001, "ÿ"), (5, 2.0, None)], key=repr)
    assert list(want["comment_text"].fillna("")) == [t or "" for _, _, t in sorted(got, key=lambda r: r[0] or 4)]
    placed = splits.csv_records(spark, path, "latin-1").orderBy("file", "start", "seq", "part").collect()
    assert [r.fields[0] for r in placed] == ["id", "1", "2", "3", "x", "5"]
    with pytest.raises(ValueError):
        files.read_annotated_csv(spark, path, schema, "utf-16")


def test_lone_carriage_returns_and_an_open_quote(spark, folder):
    path = os.path.join(folder, "old.csv")
    with open(path, "w", newline="") as f:
        f.write('id,comment_text,note\r1,"a\rb",x\r2,c,y\r3,"never closed')
    assert rows_of(files.read_annotated_csv(spark, path, TEXT).na.fill("")) == [("1", "a\rb", "x"), ("2", "c", "y"), ("3", "never closed", "")]
    with open(os.path.join(folder, "empty.csv"), "w"):
        pass
    assert files.read_annotated_csv(spark, os.path.join(folder, "empty.csv"), TEXT).count() == 0


@pytest.mark.parametrize("size, indent", [(5, None), (40, 1), (40, None), (100000, None)])
def test_json_array_equals_json_load(spark, folder, small_splits, size, indent):
    rnd = random.Random(size)
    odd = ["", "}", "{", '"', "\\", '\\"', "]},{", "é世🙂", "a\nb", "},", "\\\\"]
    data = [{"id": i, "comment_text": "".join(rnd.choices(odd, k=rnd.randint(0, 6))), "note": None if i % 5 == 0 else [rnd.choice(odd)],
             "deep": {"a": {"b": rnd.choice(odd)}}} for i in range(80)]
    data[7]["comment_text"] = "}{" * 200
    for k, part in enumerate((data[:50], data[50:], [])):
        with open(os.path.join(folder, f"{k}.json"), "w", encoding="utf-8") as f:
            json.dump(part, f, indent=indent, ensure_ascii=k == 1)
    small_splits(size)
    schema = "id long, comment_text string, note array<string>, deep struct<a: struct<b: string>>"
    got = files.read_json_records(spark, folder, T.StructType.fromDDL(schema)).collect()
    assert sorted([r.asDict(True) for r in got], key=lambda r: r["id"]) == data


def test_lists_of_tokens(spark, folder, small_splits):
    data = [["a", "b]"], [], ["[", 'q"'], ["]]"], ["x"] * 30]
    for k, part in enumerate((data, [], [["one"]])):
        with open(os.path.join(folder, f"{k}.json"), "w") as f:
            json.dump(part, f)
    small_splits(6)
    got = [r.tokens for r in files.read_json_lists(spark, folder).collect()]
    assert sorted(got) == sorted(data + [["one"]])


def test_arrays_round_trip(spark, folder):
    df = spark.createDataFrame([(i, f'say "{i}"\n') for i in range(50)], "id long, comment_text string").repartition(3)
    files.write_json_arrays(df, os.path.join(folder, "rows"))
    for name in os.listdir(os.path.join(folder, "rows")):
        if name.startswith("part"):
            with open(os.path.join(folder, "rows", name)) as f:
                assert isinstance(json.load(f), list)
    assert rows_of(files.read_json_records(spark, os.path.join(folder, "rows"), df.schema)) == rows_of(df)
    files.write_json_arrays(df.limit(0), os.path.join(folder, "none"))
    assert files.read_json_records(spark, os.path.join(folder, "none"), df.schema).count() == 0


def test_steps_compose():
    rnd = random.Random(1)
    quoted, array = splits.QuotedLines(), splits.JsonArray()
    for _ in range(500):
        text = "".join(rnd.choices('a",\n', k=rnd.randint(0, 20))).encode()
        mode = 0
        for line in text.split(b"\n")[:-1]:
            mode, _ = quoted.step(line, mode)
        whole = list(csv.reader(io.StringIO(text.rsplit(b"\n", 1)[0].decode() + "\n" if b"\n" in text else "", newline="")))
        closed = list(csv.reader(io.StringIO((text.rsplit(b"\n", 1)[0].decode() + '\n"' if b"\n" in text else ""), newline="")))
        assert mode == 0 or whole  # an open quote swallows the rest
        assert (mode == 1) == (len(closed) == len(whole)) or not whole
    value = json.dumps([{"a": '}"\\', "b": [1, {"c": "]"}]}] * 3).encode()
    mode, depth = 0, 0
    for piece in value.split(b"}")[:-1]:
        mode, change = array.step(piece, mode)
        depth += change
    assert (mode, depth) == (0, 1)


def test_batches_become_python_values_a_few_rows_at_a_time(spark):
    import pyarrow as pa
    from biasframe.sources import splits
    b = pa.RecordBatch.from_arrays([pa.array(["f"] * 500), pa.array([0] * 300 + [9] * 200, pa.int64()), pa.array([b"%d" % i for i in range(500)])], names=["file", "start", "raw"])
    got = list(splits._by_split(iter([b])))
    assert max(len(raw) for _, raw in got) <= splits.AT_ONCE
    assert [(k[1], r) for k, raw in got for r in raw] == [(0 if i < 300 else 9, b"%d" % i) for i in range(500)]
