"""Distinct long words that polynomials modulo 2**64 cannot tell apart."""

import numpy as np
from texts import frame, sha

from revlens.llm import arrays as A
from revlens.llm import bpe, decontaminate, jaccard, quality, substring_dedup


def pair(n=1024):
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_hash_and_names():
    one, two = pair()
    t = A.Texts.of(__import__("pyarrow").array([f"{one} {two} {one} x", "", "é" * 9 + " " + "é" * 9]))
    w = A.words_of(t, A.PLAIN)
    h = A.word_hash(t, w)
    assert len(set(h.tolist())) == 4 and h[0] == h[2] and h[4] == h[5]
    _, _, index = A.exact_names(t.buf, w.start, w.end, np.zeros(len(h), np.uint64))  # all share a hash: bytes decide
    assert len(set(index.tolist())) == 4 and index[0] == index[2] and index[4] == index[5]
    assert A.same_spans(t.buf, w.start[[0, 0, 4]], w.end[[0, 0, 4]], w.start[[1, 2, 5]], w.end[[1, 2, 5]]).tolist() == [False, True, True]
    many = np.arange(3000)
    buf = np.frombuffer(bytes(range(256)) * 20, np.uint8)
    whole = A.hash_bytes(buf, many, many + many % 90, A.P_BYTE)
    assert (whole == A.hash_bytes(buf, many, many + many % 90, A.P_BYTE, chunk=64)).all()


def test_operators_tell_them_apart(spark):
    one, two = pair()
    rows = [(1, one), (2, two), (3, f"{one}\n{two}\n"), (4, " ".join([one] * 20)), (5, " ".join([two] * 20))]
    docs = frame(spark, rows)
    decoded = {r.doc_id: r.decoded_sha256 for r in bpe.digest(docs).collect()}
    assert decoded == {i: sha(t) for i, t in rows}
    bench = spark.createDataFrame([("b", one)], "item_id string, text string")
    hit = {r.doc_id: r.n_hit for r in decontaminate.digest(docs, bench).collect()}
    assert hit == {1: 1, 2: 0, 3: 1, 4: 20, 5: 0}
    assert {r.doc_id: r.n_dup_lines for r in quality.score(docs).collect()}[3] == 0
    assert {r.doc_id: r.n_removed for r in substring_dedup.digest(docs).collect()}[5] == 0
    linked = {r.doc_id: r.component_id for r in jaccard.joined(docs).collect()}
    assert linked[1] != linked[2] and linked[4] != linked[5]
