"""Vectors fitted on the corpus: against a dense SVD, and words of one meaning that never occur together."""

import numpy as np
import pytest

from revlens.operators import semantic
from revlens.plans.build_index import build_index

SEATS = ["seat", "chair", "legroom", "recline"]
FOOD = ["meal", "dinner", "snack", "drink"]


def corpus():
    """Texts about seats and about food; ``chair`` and ``seat`` never share a text, ``meal`` and ``dinner`` neither."""
    rng, out = np.random.default_rng(1), []
    for i in range(400):
        kind = SEATS if i % 2 else FOOD
        names = [kind[i // 2 % 2], *kind[2:]]
        out.append((i, " ".join(rng.choice(names, 6)) + f" the x{i}"))
    return out


def vectors(df):
    return {r.id: None if r.vector is None else np.array(r.vector) for r in df.collect()}


@pytest.fixture(scope="module")
def model(spark):
    return semantic.fit(spark.createDataFrame(corpus(), "id int, text string"), "text", dim=16, features=1 << 12)


def test_words_of_one_meaning_are_near(spark):
    """Two directions for two subjects: words that are used alike share one."""
    model = semantic.fit(spark.createDataFrame(corpus(), "id int, text string"), "text", dim=2, features=1 << 12)
    v = vectors(model.embed(spark.createDataFrame([(0, "seat"), (1, "chair"), (2, "meal"), (3, "dinner")], "id int, text string"), "text"))
    assert v[0] @ v[1] > 0.5 > abs(v[0] @ v[2]) + 0.2
    assert v[2] @ v[3] > 0.5 > abs(v[1] @ v[3]) + 0.2


def test_same_subspace_as_a_dense_svd(spark, model):
    lists = spark.createDataFrame(corpus(), "id int, text string").select(semantic._features("text", 1 << 12).alias("f")).toArrow()["f"].combine_chunks()
    dense = np.zeros((400, 1 << 12))
    for rows, held, part in semantic._weighted(lists, model.idf):
        dense[np.ix_(range(rows.start, rows.stop), held)] = part
    exact = np.linalg.svd(dense, full_matrices=False)[2][:2]
    inside = np.linalg.norm(exact @ model.basis.astype(float), axis=1)
    assert (inside > 0.999).all()
    assert np.allclose(np.linalg.norm(dense @ model.basis, axis=0)[:2], np.linalg.svd(dense)[1][:2], rtol=1e-3)


def test_edges(spark, model):
    rows = [(0, None, 1), (1, "", 2), (2, "neverheardof", 3), (3, "seat " * 200_000, 4), (4, "seat", 5), (4, "seat", 5)]
    out = model.embed(spark.createDataFrame(rows, "id int, text string, _features int"), "text")
    assert out.columns == ["id", "text", "_features", "vector"]
    v = vectors(out)
    assert v[0] is None and v[1] is None
    assert len(v[3]) == 16 and np.isclose(v[3] @ v[4], 1, atol=1e-5) and np.isclose(v[4] @ v[4], 1, atol=1e-5)
    assert out.count() == 6


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "id int, text string")
    m = semantic.fit(none, "text", dim=8, features=64)
    assert m.embed(none, "text").count() == 0
    assert vectors(m.embed(spark.createDataFrame([(1, "seat")], "id int, text string"), "text")) == {1: None}


def test_tree_adds_every_piece(spark, monkeypatch):
    monkeypatch.setattr(semantic, "FAN_IN", 2)
    df = spark.createDataFrame(corpus(), "id int, text string").repartition(7).select(semantic._features("text", 256).alias("f")).checkpoint()
    basis, idf = np.eye(256, 5), np.ones(256, np.float32)
    want = np.zeros((256, 5))
    for _, held, part in semantic._weighted(df.toArrow()["f"].combine_chunks(), idf):
        want[held] += part.T @ (part @ basis[held])
    assert np.allclose(semantic._gram(df, idf, basis, df.rdd.getNumPartitions()), want, atol=1e-3)


def test_save_and_index(spark, model, tmp_path):
    model.save(spark, str(tmp_path / "model"))
    again = semantic.LsaModel.load(spark, str(tmp_path / "model"))
    assert np.array_equal(again.basis, model.basis) and np.array_equal(again.idf, model.idf)
    docs = spark.createDataFrame([(1, "seat", "a"), (2, "dinner", "b")], "id int, text string, kind string")
    index = build_index(spark, docs, str(tmp_path / "index"), id_col="id", text_col="text", entity_col="kind", dim=16, embedder=again.embed)
    assert {r.id: len(r.vector) for r in index.collect()} == {1: 16, 2: 16}
