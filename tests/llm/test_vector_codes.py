"""Operator 11 against plain numpy: nearest entries by full search, whole integers."""

import math

import numpy as np
import pytest

from revlens.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, _v string, EMBEDDING string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, k, "own", "other") for i, v, k in rows], SCHEMA).repartition(3)


def brute(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], k) for i, v, k in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1]) // parts
    x = np.array([v for _, v, _ in kept]).reshape(len(kept), parts, d)
    books = [x[:entries, p].copy() for p in range(parts)]
    for step in range(rounds + 1):
        dist = [((x[:, p, None] - books[p][None]) ** 2).sum(2) for p in range(parts)]
        index = [m.argmin(1) for m in dist]
        if step < rounds:
            for p in range(parts):
                for e in np.unique(index[p]):
                    own = x[index[p] == e, p]
                    books[p][e] = own.sum(0) // len(own)
    error = sum(m.min(1) for m in dist)
    label = {}
    for (_, _, k), e in zip(kept, error):
        label[k] = label.get(k, 0) + int(e)
    return sorted((str(i), "".join(f"{index[p][n]:02x}" for p in range(parts)), int(error[n]), label[k]) for n, (i, _, k) in enumerate(kept)), books


def got(df):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in df.collect())


def test_digest_is_the_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(size=8) / 3], [None, 1, 2][i % 3]) for i in rng.permutation(420)]
    rows += [(3, rows[0][1], 1), (3, rows[0][1], 1), rows[5], (None, rows[7][1], None)]  # ties, repeated rows, no number
    rows += [(900, None, 1), (901, [], 1), (902, [None] + [0.0] * 7, 1), (903, [math.nan] + [0.0] * 7, 2), (904, [math.inf] + [0.0] * 7, 2), (905, [0.0] * 4, 2)]
    want, books = brute([r for r in rows if r[0] != 905])
    out = V.digest(frame(spark, rows))
    assert got(out) == want
    assert {r.codebooks_sha256 for r in out.collect()} == {V.books_sha256(books)}


def test_few_equal_and_no_vectors(spark):
    rows = [(i, [0.25] * 4, 7) for i in range(5)] + [(9, [0.5, -0.0004, 0.25, 0.25], 7)]
    assert got(V.digest(frame(spark, rows))) == brute(rows)[0]
    empty = V.digest(frame(spark, rows).where("vec_id < 0"))
    assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and empty.count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        V.digest(frame(spark, [(1, [1.0] * 6, 1)]))
    with pytest.raises(Exception, match="64-bit"):
        V.digest(frame(spark, [(1, [1e9] * 4, 1)])).collect()


def test_tree_finds_the_lowest_of_the_nearest_and_leaves_subtrees_out():
    rng = np.random.default_rng(1)
    for low, high, dim in ((-3, 4, 2), (-2, 3, 5), (-1000, 1000, 3), (-(1 << 24), 1 << 24, 2)):
        book, queries = rng.integers(low, high, (256, dim)), rng.integers(low, high, (4000, dim))
        book[100:140] = book[0]  # entries that are equal, and queries that meet one
        queries[:256] = book
        tree = V.Gnat(book)
        index, d = tree.nearest(queries)
        full = ((queries[:, None] - book[None]) ** 2).sum(2)
        assert (index == full.argmin(1)).all() and (d == full.min(1)).all()
        assert tree.measured < 0.7 * full.size
    assert V.Gnat(np.zeros((40, 3), np.int64)).nearest(np.ones((2, 3), np.int64))[0].tolist() == [0, 0]


def test_codes_stand_for_their_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 1) for i in range(300)]
    t = frame(spark, rows)
    books = V.train(t, rounds=2, entries=16)
    coded = V.decode(V.encode(t, books, ["vec_id"]), books).collect()
    assert len(coded) == 300 and all(len(r.decoded) == 8 for r in coded)
    of = {i: np.floor(1024 * np.array(v, np.float32).astype(float)) for i, v, _ in rows}
    assert all(((of[r.vec_id] - 1024 * np.array(r.decoded)) ** 2).sum() == r.error for r in coded)
