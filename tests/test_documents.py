"""Operators on whole document texts, against plain Python."""

from collections import Counter

import pyarrow.parquet as pq

import __spark_entry__ as E
from biasframe.operators import vocab as V

SF = "/root/testdata/sf0.001"


def _tokens(text):
    return [w for w in (text or "").lower().translate(str.maketrans(V.DEFAULT_FILTERS, " " * len(V.DEFAULT_FILTERS))).split(" ") if w]


def test_pad_pre_keeps_250_and_150_ids(spark):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    toks = {d["doc_id"]: _tokens(d["text"]) for d in sorted(docs, key=lambda d: d["doc_id"])}
    ranked = Counter(w for t in toks.values() for w in t).most_common()  # ties by first appearance
    index = {w: i for i, (w, _) in enumerate(ranked, 1)}
    assert max(map(len, toks.values())) > 250
    for r in E.queries()["f11_pad_pre_documents"](spark, SF).collect():
        for got, n, words in ((r.padded_250, 250, 10_000), (r.padded_150, 150, 1000)):
            want = [index[w] for w in toks[r.id] if index[w] < words][-n:]
            assert got == [0] * (n - len(want)) + want


def test_vocabulary_of_five_parts_and_any_id(spark):
    parts = [[(2**61, "late"), (-5, "early late")], [(1, "one")], [(1, "two")], [(1, "three")], [(7, "five early")]]
    corp = V.corpus([spark.createDataFrame(p, "id long, text string") for p in parts])
    got = [r.word for r in V.fit_vocabulary(corp).orderBy("word_index").collect()]
    assert got == ["early", "late", "one", "two", "three", "five"]
