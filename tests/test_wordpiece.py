"""Greedy pieces by failure links against trying every length."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from biasframe.operators import wordpiece as W


def greedy(word, index, unknown):
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            text = word[at:end]
            first = not (text.startswith("##") and len(text) > 2)  # such a piece is a continuation
            i = index.get(text if at == 0 else "##" + text) if at or first else None
            if i is not None:
                break
        else:
            return [unknown]
        out.append(i)
        at = end
    return out


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("ab#", min_size=1, max_size=5), max_size=14), st.sets(st.text("ab#", min_size=1, max_size=5), max_size=14), st.lists(st.text("ab#c", max_size=12), max_size=20))
def test_links_equal_trying_all_lengths(first, later, words):
    names = sorted({w for w in first if not (w.startswith("##") and len(w) > 2)} | {"##" + w for w in later})
    index = {w: i + 10 for i, w in enumerate(names)}
    table = W.Pieces(list(index.items()), 1)
    for w in words:
        assert table.cut(w) == greedy(w, index, 1)


def test_rows(spark):
    rnd = random.Random(2)
    index = {w: i + 4 for i, w in enumerate(["un", "##aff", "##able", "a", "##a", "b", "##b", "##ab", "é", "##é"])}
    pieces = spark.createDataFrame(list(index.items()), "piece string, piece_index long")
    rows = [(i, [rnd.choice(["unaffable", "unaff", "ab", "bab", "abab", "éa", "x", "", "a" * 50]) for _ in range(rnd.randint(0, 9))], "k") for i in range(200)]
    rows += [(900, None, "k"), (901, [None, "ab"], "k")]
    got = {r.id: r.ids for r in W.encode_pieces(spark.createDataFrame(rows, "id long, words array<string>, ids string"), "words", pieces, 1).collect()}
    assert got == {i: [p for w in ws or [] if w is not None for p in greedy(w, index, 1)] for i, ws, _ in rows}
    none = W.encode_pieces(spark.createDataFrame(rows, "id long, words array<string>, ids string").limit(0), "words", pieces, 1)
    assert none.count() == 0 and none.columns == ["id", "ids"]


def test_too_many_pieces_are_refused(spark, monkeypatch):
    monkeypatch.setattr(W, "MOST_PIECES", 2)
    pieces = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "piece string, piece_index long")
    with pytest.raises(ValueError):
        W.encode_pieces(spark.createDataFrame([(1, ["a"])], "id long, words array<string>"), "words", pieces, 0)
