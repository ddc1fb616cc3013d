"""Components of the n-gram Jaccard join against brute force."""

import random

import pytest
from texts import PLAIN, corpus, frame, last, lower

from revlens.llm import blocks, jaccard


def sets(rows):
    out = []
    for _, t in rows:
        w = PLAIN.findall(lower(t))
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))))
    return out


def expected(rows):
    s, part = sets(rows), list(range(len(rows)))

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] and 100 * both >= 75 * (len(s[i]) + len(s[j]) - both):
                part[find(i)] = find(j)
    least = {}
    for i in range(len(s)):
        least[find(i)] = min(least.get(find(i), last(None)), last(rows[i][0]))
    known = lambda x: None if x == last(None) else x
    return sorted(((last(rows[i][0]), len(s[i]), known(least[find(i)])) for i in range(len(s))), key=str)


@pytest.fixture
def small_blocks(monkeypatch):
    pack = blocks.pack
    monkeypatch.setattr(blocks, "pack", lambda docs, text="text", block_bytes=3000: pack(docs, text, block_bytes))


def family(seed=1, n=30):
    """A family of near copies that is only connected through each other, and strangers with its passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randint(0, 119)] = word()
        out.append((200 + i, " ".join(w)))
        base = w if i % 3 == 0 else base  # the family drifts
    return out + [(400 + i, " ".join(base[:40] + [word() for _ in range(60)])) for i in range(6)]


def test_components(spark, small_blocks):
    rows = corpus() + family()
    got = [(last(r.doc_id), r.n_shingles, r.component_id) for r in jaccard.joined(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == expected(rows)


def test_one_of_each(spark, small_blocks):
    rows = [(9, "a b c d e f g"), (4, "A b c d e f g"), (4, "a b c d e f g"), (None, "a b c d e f g"), (5, "x"), (6, None), (6, None), (7, "p q r s t u")]
    out = jaccard.one_of_each(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "block", "bucket", "TEXT"]
    assert sorted(r[0] for r in out.collect()) == [4, 5, 6, 6, 7]


def test_empty(spark):
    assert jaccard.joined(frame(spark, [])).collect() == []


def test_open_pairs_skip_blocks_only_where_no_link_can_be():
    """Every pair of a list that sizes and positions allow is found, with and without skipping."""
    import numpy as np
    import pyarrow as pa

    from revlens.llm import blocks as B

    rng = np.random.default_rng(4)
    n = 300
    size = rng.integers(20, 60, n).astype(np.uint32)
    pos = (rng.random(n) * size * 0.5).astype(np.uint32)
    node = rng.integers(0, 2**63, (n, 2)).astype(np.uint64)
    part = node.copy()
    part[::3] = part[0]
    body = B.dump(np.full(n, 5, np.uint64), pos, np.arange(n, dtype=np.uint32), size, node.reshape(-1), part.reshape(-1))
    got = jaccard._open_pairs(75)(pa.table({"body": pa.array([body], pa.binary())}))
    want = set()
    for i in range(n):
        for j in range(i):
            a, b = int(size[i]), int(size[j])
            left = min(a - int(pos[i]), b - int(pos[j]))
            if (part[i] != part[j]).any() and 100 * min(a, b) >= 75 * max(a, b) and left >= -(-75 * (a + b) // 175):
                want.add(frozenset((node[i].tobytes(), node[j].tobytes())))
    assert {frozenset(p) for p in zip(got["a"].to_pylist(), got["b"].to_pylist())} == want and len(want) > 100


@pytest.mark.parametrize("group", [256, 4])
def test_links_and_classes(spark, small_blocks, monkeypatch, group):
    """Also links between sets of one component that others connect, in one group and between groups."""
    monkeypatch.setattr(jaccard, "GROUP", group)
    rows = corpus() + family()
    s = sets(rows)
    link = lambda a, b: a != b and 100 * len(a & b) >= 75 * len(a | b)
    want = sorted((last(i), len(x), sum(link(x, y) for y in set(s)) if x else 0) for (i, _), x in zip(rows, s))
    out = jaccard.links(frame(spark, rows)).collect()
    assert sorted((last(r.doc_id), r.n_shingles, r.n_links) for r in out) == want
    assert len({r.node for r in out if r.node}) == len({x for x in s if x}) and all((r.node is None) == (r.n_shingles == 0) for r in out)
    assert len({n for _, _, n in want}) > 3  # not every pair of a component links
