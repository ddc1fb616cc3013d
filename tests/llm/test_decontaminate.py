"""Benchmark windows against brute force, broadcast and joined."""

import pytest
from texts import ALNUM, corpus, frame, lower, sha

from revlens.llm import blocks, decontaminate


def expected(rows, items, width=10):
    windows = {}
    for item, t in items:
        w = ALNUM.findall(lower(t))
        for i in range(len(w) - min(width, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(item)
    out = []
    for i, t in rows:
        w, found = ALNUM.findall(lower(t)), set()
        hit = [False] * len(w)
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    found |= windows[tuple(w[k : k + n])]
                    hit[k : k + n] = [True] * n
        listed = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), sum(hit), len(listed), sha(",".join(listed)), any(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_hits(spark, monkeypatch, limit):
    pack = blocks.pack
    monkeypatch.setattr(blocks, "pack", lambda docs, text="text", block_bytes=2000: pack(docs, text, block_bytes))
    rows = corpus()
    words = rows[4][1].split()
    items = [(10, " ".join(words[5:30])), (9, rows[8][1]), (9, "two words"), (7, rows[8][1].upper()), (None, "ONE"), (5, None), (6, "!? ."), (3, " ".join(words[20:27])), (2, "x" * 400)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate.digest(frame(spark, rows), bench, broadcast_bytes=limit).collect()), key=str)
    assert got == expected(rows, items)
    assert sum(r[5] for r in got) > 8


def test_clean(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    rows = [(1, "x A,b-C y"), (2, "a b"), (3, None), (2, "a b")]
    out = decontaminate.clean(frame(spark, rows), bench)
    assert out.columns == ["doc_id", "text", "block", "bucket", "TEXT"]
    assert sorted(r[0] for r in out.collect()) == [2, 2, 3]
    assert decontaminate.clean(frame(spark, rows), bench.limit(0)).count() == 4
    assert decontaminate.digest(frame(spark, []), bench).collect() == []
