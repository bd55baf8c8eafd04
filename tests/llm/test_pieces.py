"""Sentence-piece encoding against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from biasframe.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
FIXED = [None, "", " ", "\n", "\n x", "a\u2581b", "\u2581\u2581", " \u2581 ", "  a  b ", "<s> </s><unk><0x41>", "a\0b", "\t\r\n", " " * 9000,
         "z" * 6000, "\u4e16\u754c" * 4000, "\U0001f642\U0001f44d\U0001f3fd ok\u200d", "\ufb01\u00bd A\u030a", "a \n", "one", "one"]


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def random_texts(n):
    rnd = random.Random(11)
    parts = [*"abcdeEst \n\u2581.,'0129\u00e9\u4e16\U0001f642\t", "the", "ing", " ", "   ", "tion", " of", "\u00e9"]
    return ["".join(rnd.choices(parts, k=rnd.randint(1, 60))) for _ in range(n)]


def test_ids_and_texts_equal_the_library(lib):
    codec = pieces.Codec(PATH)
    texts = [t or "" for t in FIXED] + random_texts(4000)
    assert [x.tolist() for x in codec.encode_all(texts)] == lib.encode(texts)
    assert [codec.model.decode(x) for x in lib.encode(texts)] == [lib.decode(x) for x in lib.encode(texts)]


def test_any_ids_decode_as_in_the_library(lib):
    rnd, m = random.Random(7), pieces.model(PATH)
    for _ in range(4000):
        ids = [rnd.choice([rnd.randrange(32000), rnd.randrange(3, 259), rnd.randrange(3), 28705]) for _ in range(rnd.randint(0, 9))]
        assert m.decode(ids) == lib.decode(ids)


def test_a_small_memo_changes_nothing(lib, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO_UNITS", 50)
    monkeypatch.setattr(pieces, "MEMO_PAIRS", 20)
    codec, texts = pieces.Codec(PATH), random_texts(400)
    codec.model._forget()
    for at in range(0, len(texts), 20):
        assert [x.tolist() for x in codec.encode_all(texts[at:at + 20])] == lib.encode(texts[at:at + 20])


def test_backtracking_takes_pieces_back(lib):
    """Greedy longest pieces alone would give other ids on some of these."""
    m, greedy = pieces.model(PATH), 0
    units = ["\u2581" + w for t in random_texts(500) for w in t.split(" ") if w and "\u2581" not in w]
    flat, count = m.pieces_short(units)
    for word, own in zip(units, np.split(flat, np.cumsum(count)[:-1])):
        at, longest, found = 0, [], m.back.run(word[::-1])[::-1]
        while at < len(word):
            longest.append(m._first(found, word, at))
            at += int(m.size[longest[-1]])
        greedy += longest != own.tolist()
        assert m.pieces_long(word) == own.tolist()
    assert greedy > 20


def test_rows_nulls_and_clashing_names(spark, lib):
    rows = [(i if i else None, t, "x", 1) for i, t in enumerate(FIXED)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    got = pieces.encode_decode(docs, PATH).collect()
    for r in got:
        assert r.ids == lib.encode(r.text or "") and r.n_tokens == len(r.ids) and r.decoded == lib.decode(r.ids)
    assert len(got) == len(FIXED) and got[0].doc_id is None
    assert pieces.encode_decode(docs.limit(0), PATH).count() == 0
    digests = pieces.encode_decode(docs, PATH, digests=True)
    assert digests.columns == ["doc_id", "text", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = [hashlib.sha256(",".join(map(str, lib.encode(t or ""))).encode()).hexdigest() for t in FIXED]
    assert [r.ids_sha256 for r in digests.collect()] == want
