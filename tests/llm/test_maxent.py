"""Base scores against brute force; the model is a distribution and beats the base on held-out texts."""

import math
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from texts import PLAIN, corpus, frame, lower

from revlens.llm import blocks, maxent


def tokens(text):
    return [*PLAIN.findall(lower(text)), None]


def test_base(spark, monkeypatch):
    pack = blocks.pack
    monkeypatch.setattr(blocks, "pack", lambda docs, text="text", block_bytes=4000: pack(docs, text, block_bytes))
    rows = corpus()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    count = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = [(i, held(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in rows]
    got = [tuple(r) for r in maxent.score(frame(spark, rows)).collect()]
    key = lambda r: (str(r[:5]), r[5])
    for a, b in zip(sorted(want, key=key), sorted(got, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6) and math.isfinite(b[6])


def test_learns_order(spark):
    """Texts with a grammar: the model's held-out score is well above the base's, which cannot see order."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(150):
        w = []
        for _ in range(40):
            w += [f"a{rng.integers(3)}", "of", "the", f"noun{rng.integers(400)}"]
        rows.append((i, " ".join(w)))
    got = [r for r in maxent.score(frame(spark, rows)).collect() if r.held_out]
    assert len(got) > 10
    assert sum(r.score for r in got) / sum(r.n_tokens for r in got) > sum(r.base_score for r in got) / sum(r.n_tokens for r in got) + 0.25


def test_distribution():
    """Class probabilities of any features sum to one."""
    rng = np.random.default_rng(1)
    w, b = rng.normal(size=(maxent.FEATURES, maxent.CLASSES)).astype(np.float32), rng.normal(size=maxent.CLASSES).astype(np.float32)
    rows = [rng.integers(0, maxent.FEATURES, 50) for _ in range(3)]
    assert np.exp(maxent._log_probabilities(w, b, rows)).sum(1) == pytest.approx(np.ones(50), abs=1e-4)


def test_no_training_documents(spark):
    i = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = maxent.score(frame(spark, [(i, "a b")])).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and math.isfinite(r.score)
    assert maxent.score(frame(spark, [])).collect() == []


def rate(rows, column):
    return sum(r[column] for r in rows) / sum(r.n_tokens for r in rows)


def test_every_word_determines_the_next(spark):
    """200 words in a fixed cycle: held-out texts are nearly certain, which no class of counts can tell."""
    rows = [(i, " ".join(f"w{(i * 37 + j) % 200}" for j in range(100))) for i in range(120)]
    got = [r for r in maxent.score(frame(spark, rows)).collect() if r.held_out]
    assert rate(got, "score") > -0.2 and rate(got, "base_score") < -2


def test_score_against_brute_force(spark):
    """The same weights, token by token in plain Python; the words that can follow sum to one."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.geometric(0.15, rng.integers(0, 30)))) for i in range(60)] + [(60, None), (60, "w1 new w1")]
    coded, types, tokens_ = maxent.code(frame(spark, rows))
    weights, bias, m = maxent.train(coded, types, tokens_)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count, pair = Counter(), Counter()
    for i, t in rows:
        if not held(i):
            w = tokens(t)
            count.update(w)
            pair.update(zip([None, *w], w))
    cls = lambda w: int(math.log2(max(count[w], 1)))
    inside = lambda w: count[w] / sum(n for v, n in count.items() if cls(v) == cls(w)) if cls(w) else 1 / (sum(n == 1 for n in count.values()) + 1)

    def logs(words):
        """Class log probabilities before every word, by the operator's features."""
        hashes, first = maxent._tokens(frame_table(b" ".join(w for w in words if w).decode()))
        return maxent._log_probabilities(weights, bias, maxent._features((hashes >> np.uint64(32)) + np.uint64(1), first))

    def probability(p, last, w):
        k = maxent.class_of(np.array([count[last]]))[0]
        return (pair[last, w] + m[k] * math.exp(p[cls(w)]) * inside(w)) / (count[last] + m[k])

    want = []
    for i, t in rows:
        w = tokens(t)
        p = logs(w)
        want.append((i, sum(math.log10(probability(p[j], w[j - 1] if j else None, w[j])) for j in range(len(w)))))
        for j in range(0, len(w), 7):
            total = sum(probability(p[j], w[j - 1] if j else None, v) for v in [*count, "never seen"])
            assert total == pytest.approx(1, abs=1e-4)
    got = [(r.doc_id, r.score) for r in maxent.scored(coded, (weights, bias, m), types, tokens_).collect()]
    assert [a for a, _ in sorted(want)] == [a for a, _ in sorted(got)]
    assert [b for _, b in sorted(want)] == pytest.approx([b for _, b in sorted(got)], abs=1e-3)


def plain_step(weights, bias, rows, into):
    """A batch's expected counts in plain numpy."""
    x = weights[rows[0]] + weights[rows[1]] + weights[rows[2]] + bias
    x = np.exp(x - x.max(1, keepdims=True))
    x /= x.sum(1, keepdims=True)
    for r in rows:
        order = np.argsort(r, kind="stable")
        heads = np.flatnonzero(np.diff(r[order], prepend=-1))
        into[r[order][heads]] += np.add.reduceat(x[order], heads)


def step(weights, bias, rows, into):
    expected = maxent._probabilities(weights, bias, rows)
    for r in rows:
        maxent._sum_rows(into, r, expected)


def test_expected_counts_cost():
    """A batch of the gradient gives the plain form's counts, bit for bit, in well under its CPU time."""
    rng = np.random.default_rng(5)
    for classes in (1, 7, 23, maxent.CLASSES):
        w, b = rng.normal(size=(maxent.FEATURES, classes)).astype(np.float32), rng.normal(size=classes).astype(np.float32)
        b[classes // 2 :: 3] = b[0] if classes < 3 else -np.inf  # classes without tokens
        rows = [np.minimum(rng.geometric(1e-3, maxent.BATCH), maxent.FEATURES) - 1, *rng.integers(0, maxent.FEATURES, (2, maxent.BATCH))]
        took, sums = {plain_step: [], step: []}, {}
        for _ in range(7):
            for f in took:
                sums[f] = np.zeros((maxent.FEATURES, classes))
                began = time.process_time()
                f(w, b, rows, sums[f])
                took[f].append(time.process_time() - began)
        assert np.array_equal(sums[plain_step], sums[step])
        assert classes < 20 or min(took[step]) < 0.85 * min(took[plain_step])


def test_words_are_worked_out_once(spark, monkeypatch):
    """What a word decides alone (its class, its hashes) is worked out once a word of a block, not once a token."""
    coded, _, _ = maxent.code(frame(spark, [(i, "a b c d " * 500) for i in range(5)]))
    arrays = [blocks.load(bytes(r.body)) for r in coded.collect()]
    asked = {"class_of": 0, "mix": 0}
    for name in asked:
        f = getattr(maxent, name)
        monkeypatch.setattr(maxent, name, lambda x, name=name, f=f: asked.update({name: asked[name] + len(x)}) or f(x))
    n = sum(len(maxent.Block(a).cls) for a in arrays)
    assert n == 5 * 2001 and asked["class_of"] < 100 and asked["mix"] < n + 100  # pairs are hashed once a token


def frame_table(text):
    return pa.table({"doc_id": pa.array([0], pa.int64()), "text": pa.array([text])})
