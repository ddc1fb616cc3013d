"""Property checks (hypothesis): Spark expressions vs Python semantics on
random inputs, ordering/numbering invariants, upsert idempotence."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from revlens.functions.casts import safe_int
from revlens.functions.text import py_strip, split_flag_body
from revlens.operators.ordered import with_row_index
from revlens.sources.index import upsert

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
WS = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0    　"
texty = st.text(alphabet=st.sampled_from(list(WS) + list("ab|Zé1+-.") + ["é", "中"]), max_size=12)


@SETTINGS
@given(st.lists(texty, min_size=1, max_size=60))
def test_strip_and_split_match_python(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    flag, body = split_flag_body("s")
    got = {r.i: (r.st, r.f, r.b) for r in df.select("i", py_strip("s").alias("st"), flag.alias("f"),
                                                    body.alias("b")).collect()}
    for i, v in enumerate(values):
        pieces = v.split("|")
        want = (v.strip(), pieces[0].strip() if len(pieces) == 2 else None, pieces[-1].strip())
        assert got[i] == want, (v, got[i], want)


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["", " ", "\t", "　"]), st.sampled_from(["", "+", "-"]),
                          st.integers(min_value=0, max_value=10**12), st.sampled_from(["", " ", ".0", "x"])),
                min_size=1, max_size=40))
def test_safe_int_matches_python_int(spark, parts):
    values = [f"{a}{b}{n}{c}" for a, b, n, c in parts]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    got = {r.i: r.n for r in df.select("i", safe_int("s").alias("n")).collect()}
    for i, v in enumerate(values):
        want = int(v) if re.fullmatch(r"\s*[+-]?[0-9]+\s*", v) else None
        assert got[i] == want, v


@SETTINGS
@given(st.lists(st.sampled_from(["hot", "hot", "hot", "a", "b", "c"]), min_size=1, max_size=200),
       st.integers(min_value=1, max_value=9))
def test_row_index_follows_sorted_order(spark, keys, nparts):
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i long")
    got = sorted((r.rid, r.k, r.i) for r in with_row_index(df, ["k", "i"], "rid", num_partitions=nparts).collect())
    want = [(n, k, i) for n, (k, i) in enumerate(sorted((k, i) for i, k in enumerate(keys)))]
    assert got == want


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 5)), max_size=40))
def test_upsert_idempotent_last_wins(spark, batch):
    base = spark.createDataFrame([(i, -1) for i in range(0, 20, 2)], "id long, v long")
    upd = spark.createDataFrame([(i, v, n) for n, (i, v) in enumerate(batch)] or [(0, 0, 0)][:0],
                                "id long, v long, seq long")
    once = upsert(base, upd, "id", "seq")
    twice = upsert(once, upd, "id", "seq")
    a = sorted(map(tuple, once.collect()))
    assert a == sorted(map(tuple, twice.collect()))
    expect = {i: -1 for i in range(0, 20, 2)}
    for i, v in batch:
        expect[i] = v
    assert a == sorted(expect.items())
    assert once.where(F.col("id").isNull()).count() == 0
