"""Operator 12 against plain Python integers."""

import re
from collections import Counter

import pytest
from texts import corpus, lower

from revlens.llm import divergence as D

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n long, TEXT string, term string"


def table(seed=4, n=60):
    rows = []
    for k, (i, text) in enumerate(corpus(seed, n)):
        rows.append((i, text, [None, "en", "en", "de", "", "solo"][k % 6], [None, "a", "b", "c", "d"][k % 5] if k % 6 != 5 else "only"))
    rows += [(7, "123 .. 99", "en", "without"), (8, None, "xx", "p"), (9, "rare", "xx", "q"), (10, "x" * 70_000 + " tail", "en", "a")]
    return rows + rows[:4]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, s, 1, "other", "own") for i, t, g, s in rows], SCHEMA).repartition(4)


def brute(rows, min_docs=3, top=200):
    docs = [(g or "", s or "", TERM.findall(lower(t))) for _, t, g, s in rows]
    out = []
    for lang in {g for g, _, _ in docs}:
        own = [(s, w) for g, s, w in docs if g == lang]
        seen = Counter(x for _, w in own for x in set(w))
        kept = sorted(x for x, n in seen.items() if n >= min_docs)
        n = {s: Counter() for s, _ in own}
        for s, w in own:
            n[s].update(x for x in w if seen[x] >= min_docs)

        def share(c, x, kept=kept):
            return 1 + 10**9 * (c[x] + 1) // (sum(c.values()) + len(kept))

        all_ = sum(n.values(), Counter())
        for s in n:
            ranked = sorted((-sum((share(n[s], x) - share(n[o], x)) ** 2 // share(n[o], x) for x in kept), o.encode()) for o in n if o != s)
            out += [(lang, s, "pair", o.decode(), -v, r) for r, (v, o) in enumerate(ranked, 1)]
            own_terms = [(share(n[s], x), share(all_, x), x) for x in kept if n[s][x]]
            ranked = sorted((-((p - q) ** 2 // q), x) for p, q, x in own_terms if p > q)[:top]
            out += [(lang, s, "term", x.decode(), -v, r) for r, (v, x) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("bits,top", [(64, 200), (64, 3), (5, 200), (5, 4)])
def test_audit_is_the_brute_force_also_where_digests_collide(spark, bits, top):
    rows = table()
    out = D.audit(frame(spark, rows), top=top, digest_bits=bits)
    assert sorted(map(tuple, out.collect())) == brute(rows, top=top)


def test_no_documents_and_no_kept_terms(spark):
    assert D.audit(frame(spark, table()).where("doc_id < 0")).count() == 0
    rows = [(1, "one two", "en", "a"), (2, None, "en", "b")]
    assert sorted(map(tuple, D.audit(frame(spark, rows)).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_a_task_that_passes_on_its_sums_early():
    """Rows of several flushes and ranges add up to the whole."""
    import numpy as np
    import pyarrow as pa

    from revlens.llm import blocks as B

    got, texts = Counter(), set()
    rows = table(9, 30)
    sums = D._Sums(0, 64, None)
    batches = []
    for k, (_, t, g, s) in enumerate(rows):
        sums.add([g or ""], [s or ""], pa.array([t], pa.string()))
        if k % 7 == 6:
            batches += sums.rows(5)
    for b in [*batches, *sums.rows(5)]:
        r = b.to_pylist()[0]
        if r["part"] >= 0:
            names = D.json.loads(r["groups"])
            d, g, n, docs = B.load(r["counts"])
            named, size, data = B.load(r["texts"])
            assert set(d.tolist()) == set(named.tolist()) and (docs <= n).all()
            texts |= set(D._strings(data, size.astype(np.int64)).to_pylist())
            for k, v in zip(g.tolist(), n.tolist()):
                got[tuple(names[k])] += v
    want = Counter()
    for _, t, g, s in rows:
        want[(g or "", s or "")] += len(TERM.findall(lower(t)))
    assert +got == +want and texts == {x.decode() for _, t, _, _ in rows for x in TERM.findall(lower(t))}


def test_share_does_not_leave_64_bits(spark):
    from pyspark.sql import functions as F

    n, total, kept = 3 * 10**12, 5 * 10**13, 10**9
    row = spark.range(1).select(D.share(F.lit(n).cast("long"), F.lit(total).cast("long"), F.lit(kept).cast("long")).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 1) // (total + kept)
