"""Substring and suffix-array dedup against brute force."""

import pytest
from texts import frame, last, corpus, plain, sha

from revlens.llm import blocks, substring_dedup, suffix_dedup


def expected_words(rows, width):
    first = {}
    for i, t in rows:
        w = plain(t)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, last(None)), last(i))
    out = []
    for i, t in rows:
        w, own = plain(t), set()
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if first[key] < last(i) or key in own:
                gone[k : k + width] = [True] * width
            own.add(key)
        out.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def expected_bytes(rows, width):
    first = {}
    for i, t in rows:
        x = (t or "").encode()
        for k in range(len(x) - width + 1):
            first[x[k : k + width]] = min(first.get(x[k : k + width], last(None)), last(i))
    out = []
    for i, t in rows:
        x = (t or "").encode()
        gone = [False] * len(x)
        for k in range(len(x) - width + 1):
            if first[x[k : k + width]] < last(i):
                gone[k : k + width] = [True] * width
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(x), sum(gone), spans, sha(bytes(c for c, g in zip(x, gone) if not g))))
    return out


def by_text(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.fixture
def small_blocks(monkeypatch):
    """Many blocks, so that equal passages meet across them."""
    pack = blocks.pack
    monkeypatch.setattr(blocks, "pack", lambda docs, text="text", block_bytes=1500: pack(docs, text, block_bytes))


def test_words(spark, small_blocks):
    rows = corpus()
    got = [tuple(r) for r in substring_dedup.digest(frame(spark, rows)).collect()]
    assert by_text(got) == by_text(expected_words(rows, 20))
    assert sum(r[2] for r in got) > 500


def test_short_windows(spark, small_blocks):
    """Windows too short for the top symbols to help."""
    rows = corpus(seed=8, n=12)
    got = [tuple(r) for r in substring_dedup.digest(frame(spark, rows), width=4).collect()]
    assert by_text(got) == by_text(expected_words(rows, 4))


def test_bytes(spark, small_blocks):
    rows = corpus(seed=5)
    got = [tuple(r) for r in suffix_dedup.digest(frame(spark, rows)).collect()]
    assert by_text(got) == by_text(expected_bytes(rows, 50))
    assert sum(r[2] for r in got) > 2000


def test_whole_rows(spark):
    """All columns stay, characters go as a whole, null stays null, words come out as text."""
    rows = [(1, "é日" * 60), (2, "xé日" + "é日" * 60 + "y"), (3, None)]
    out = suffix_dedup.remove_repeats(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "block", "bucket", "TEXT"]
    assert {r[0]: r[1] for r in out.collect()} == {1: "é日" * 60, 2: "xy", 3: None}
    out = substring_dedup.remove_repeats(frame(spark, [(1, " ".join(map(str, range(30)))), (2, "a " + "  ".join(map(str, range(25))) + " b")]))
    assert {r.doc_id: r.text for r in out.collect()}[2] == "a b"


def test_empty(spark):
    none = frame(spark, [])
    assert substring_dedup.digest(none).collect() == [] and suffix_dedup.digest(none).collect() == []
    assert suffix_dedup.remove_repeats(none).collect() == []


def test_widths():
    with pytest.raises(ValueError):
        suffix_dedup.removed_bytes(None, None, "", width=20, trigger=24)
