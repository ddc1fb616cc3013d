"""A vocabulary table: both forms against each other, the regular expression and a brute-force version."""

import re

import pytest

from revlens.operators.understand import vocab_match
from revlens.operators.vocabulary import entries_of, match_vocabulary

VOCAB = [("Red Widget", "rw"), ("widget", "w"), ("red", "r"), ("widget  stand", "ws"), ("a b c", "abc"), ("b", "b"), ("Red-Widget", "aa"), ("!", "none"), (None, "none")]
TEXTS = [(1, "A red widget stand"), (2, "widgets reds"), (3, None), (4, ""), (5, "b a b c"), (6, "the red, WIDGET"), (7, "red b"), (8, "x " * 30_000 + "a b c"), (None, "red"), (9, "red widget red widget")]


def brute(text):
    found = {}
    tokens = re.findall(r"[^\W_]+", (text or "").lower())
    known = {}
    for surface, value in VOCAB:
        key = " ".join(re.findall(r"[^\W_]+", (surface or "").lower()))
        if key:
            known[key] = min(known.get(key, value), value)
    for key in known:
        n = len(key.split())
        for i in range(len(tokens) - n + 1):
            if " ".join(tokens[i:i + n]) == key:
                found.setdefault(key, i)
    best = min(found, key=lambda k: (-len(k), found[k]), default=None)
    return (known.get(best), best, len(found))


@pytest.mark.parametrize("strategy", ["sent", "joined", "auto"])
def test_against_brute_force(spark, strategy):
    df = spark.createDataFrame(TEXTS, "id int, text string")
    out = match_vocabulary(df, "id", "text", spark.createDataFrame(VOCAB, "s string, v string"), "s", "v", strategy)
    assert out.columns == ["id", "text", "value", "entry", "n_found"]
    assert {r.id: (r.value, r.entry, r.n_found) for r in out.collect()} == {i: brute(t) for i, t in TEXTS}
    assert out.count() == len(TEXTS)


def test_as_the_regular_expression(spark):
    small = [("red widget", "rw"), ("widget", "w"), ("red", "r"), ("b", "b")]
    df = spark.createDataFrame(TEXTS[:2] + TEXTS[3:5], "id int, text string").withColumn("want", vocab_match("text", small))
    out = match_vocabulary(df, "id", "text", spark.createDataFrame(small, "s string, v string"), "s", "v", "joined")
    assert out.where("NOT value <=> want").count() == 0


@pytest.mark.parametrize("strategy", ["sent", "joined"])
def test_empty_tables(spark, strategy):
    df, vocab = spark.createDataFrame(TEXTS, "id int, text string"), spark.createDataFrame(VOCAB, "s string, v string")
    assert match_vocabulary(df.limit(0), "id", "text", vocab, "s", "v", strategy).count() == 0
    assert match_vocabulary(df, "id", "text", vocab.limit(0), "s", "v", strategy).where("value IS NOT NULL OR n_found <> 0").count() == 0
    with pytest.raises(ValueError):
        match_vocabulary(df.withColumn("value", df.id), "id", "text", vocab, "s", "v", strategy)


def test_hundred_thousand_entries(spark):
    vocab = spark.range(100_000).selectExpr("concat('w', id, ' w', id + 1) AS s", "id AS v")
    df = spark.range(500).selectExpr("id", "concat('x w', id * 200, ', w', id * 200 + 1, ' end') AS text")
    a, b = (match_vocabulary(df, "id", "text", vocab, "s", "v", k) for k in ("sent", "joined"))
    assert entries_of(vocab, "s", "v").count() == 100_000
    assert a.exceptAll(b).count() == 0 and a.where("value = id * 200 AND n_found = 1").count() == 500


def test_vocabulary_is_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)
    vocab = spark.createDataFrame(VOCAB, "s string, v string").rdd.map(lambda r: (seen.add(1), tuple(r))[1]).toDF("s string, v string")
    df = spark.createDataFrame(TEXTS, "id int, text string")
    out = match_vocabulary(df, "id", "text", vocab, "s", "v", "joined")
    assert {r.id: (r.value, r.entry, r.n_found) for r in out.collect()} == {i: brute(t) for i, t in TEXTS}
    assert seen.value == len(VOCAB)
