"""Vector codes against plain rounds of assignment and rounded-down means."""

import hashlib

import numpy as np
import pytest

from biasframe.llm import codes


def plain(x, parts, entries, rounds):
    """x: rows in id order."""
    n, width = len(x), x.shape[1] // parts
    x = x.reshape(n, parts, width)
    book = x[:entries].transpose(1, 0, 2).copy()

    def nearest():
        d = ((x[:, :, None, :] - book[None]) ** 2).sum(3)
        return d.argmin(2), d.min(2)

    for _ in range(rounds):
        own, _ = nearest()
        for p in range(parts):
            for e in range(book.shape[1]):
                if (own[:, p] == e).any():
                    book[p, e] = x[own[:, p] == e, p].sum(0) // (own[:, p] == e).sum()
    own, d = nearest()
    return own, d.sum(1), book


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string, q int").repartition(3)


@pytest.fixture(scope="module")
def vectors():
    rnd = np.random.RandomState(13)
    x = np.concatenate([rnd.normal(0, 0.2, (500, 32)), rnd.normal(0.5, 0.02, (200, 32)), np.repeat(rnd.normal(0, 0.2, (1, 32)), 300, 0), rnd.randint(-2, 3, (200, 32)) / 256])
    return x[rnd.permutation(len(x))]


@pytest.mark.parametrize("entries, rounds", [(64, 2), (7, 3), (2, 1), (64, 5)])
def test_equals_plain_rounds(spark, vectors, entries, rounds):
    rows = [(i * 3, v.tolist(), None if i % 3 == 0 else i % 5, "x", 1) for i, v in enumerate(vectors)]
    rows += [(1, None, 1, "x", 1), (4, [None] + [0.0] * 31, 1, "x", 1), (5, [float("nan")] * 32, 1, "x", 1), (7, [float("inf")] * 32, 1, "x", 1), (8, [], 1, "x", 1), (10, [0.5] * 31, 1, "x", 1), (11, [0.5] * 48, 1, "x", 1)]
    coded, book = codes.compress(table(spark, rows), 16, entries, rounds)
    q = np.floor(256 * vectors).astype(np.int64)
    own, error, want = plain(q, 16, entries, rounds)
    assert (book == want).all()
    got = {r.vec_id: r for r in coded.collect()}
    assert len(got) == len(vectors)
    for i in range(len(vectors)):
        assert list(got[3 * i].code) == own[i].tolist() and got[3 * i].error == error[i]
    if rounds == 5:  # the bounds spare most distances once the entries move little
        assert np.mean([r.measured for r in got.values()]) < 0.6 * 16 * 65


def test_ids_twice_nulls_and_few_rows(spark):
    rows = [(2, [0.5] * 16, None, "x", 1), (2, [0.25] * 16, 3, "x", 1), (None, [0.0] * 16, None, "x", 1), (2, [0.5] * 16, None, "x", 1)]
    got = sorted((r.vec_id or -1, r.code, r.error, r.label_error, r.codebooks_sha256) for r in codes.code_table(table(spark, rows)).collect())
    # entries by id, then vector: .25, .5, .5, 0; equal entries go to the first, so the third stays unused
    numbers = ",".join(",".join(map(str, (64, 128, 128, 0))) for _ in range(16))
    digest = hashlib.sha256(numbers.encode()).hexdigest()
    assert got == [(-1, "03" * 16, 0, 0, digest), (2, "00" * 16, 0, 0, digest), (2, "01" * 16, 0, 0, digest), (2, "01" * 16, 0, 0, digest)]
    assert codes.code_table(table(spark, rows).limit(0)).count() == 0
    assert codes.code_table(table(spark, [(1, None, 1, "x", 1)])).count() == 0
    with pytest.raises(Exception, match="must be at most"):
        codes.code_table(table(spark, [(1, [1e300] * 16, 1, "x", 1)])).collect()


def test_bounds_never_rise():
    rnd = np.random.RandomState(1)
    b = np.r_[rnd.rand(1000) * 10.0 ** rnd.randint(-8, 6, 1000), np.inf, 0].astype(np.float32)
    assert (codes.down(b).astype(np.float32) <= b).all() and np.isinf(codes.down(b)[-2])
    d2 = rnd.randint(0, 2**60, 1000)
    assert all(int(np.float64(r) ** 2) <= int(v) for r, v in zip(codes.below(d2), d2))


def test_wide_numbers_are_measured_exactly():
    rnd = np.random.RandomState(2)
    x, book = rnd.randint(-2**24, 2**24, (50, 4)), rnd.randint(-2**24, 2**24, (9, 4))
    assert (codes.distances(x, book) == ((x[:, None] - book[None]) ** 2).sum(2)).all()
