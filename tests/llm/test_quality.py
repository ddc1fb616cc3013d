"""Repetition counts against brute force."""

from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from texts import corpus, frame, plain

from revlens.llm import quality


def expected(text):
    w, t = [x.decode() for x in plain(text)], text or ""
    n = len(w)

    def covered(k):
        count = Counter(tuple(w[i : i + k]) for i in range(n - k + 1))
        flags = [False] * n
        for i in range(n - k + 1):
            if count[tuple(w[i : i + k])] > 1:
                flags[i : i + k] = [True] * k
        return sum(flags)

    longest = 0
    while longest < n and len({tuple(w[i : i + longest + 1]) for i in range(n - longest)}) < n - longest:
        longest += 1
    lines = [x for x in t.split("\n") if plain(x)]
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), covered(3), covered(10), longest


def measured(texts):
    m = quality.measure(pa.array(texts, pa.string()))
    return [tuple(int(m[c][i]) for c in quality.COUNTS) for i in range(len(texts))]


def test_counts():
    texts = [t for _, t in corpus()] + ["a\na\n", "\n\nx\nx", "x\n", "\n", "a  \na  \na", "#*$%&|<> é"]
    assert measured(texts) == [expected(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab \n\t#é", max_size=40)), max_size=6))
def test_any_text(texts):
    assert measured(texts) == [expected(t) for t in texts]


def test_verdict(spark):
    clean = " ".join(f"w{i}" for i in range(200))
    block = " ".join(f"r{i}" for i in range(45))
    rows = [(1, clean), (2, "short text"), (3, None), (4, "again and again " * 40), (5, clean + " " + block + " " + block), (6, clean + "\n" + clean[:60])]
    got = {r.doc_id: r for r in quality.score(frame(spark, rows)).collect()}
    assert {i: (r.base_failed, r.kept) for i, r in got.items()} == {1: (False, True), 2: (True, False), 3: (True, False), 4: (True, False), 5: (False, False), 6: (False, True)}
    kept = quality.keep(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "block", "bucket", "TEXT"] and sorted(r.doc_id for r in kept.select("doc_id").collect()) == [1, 6]
    assert quality.score(frame(spark, [])).collect() == []
