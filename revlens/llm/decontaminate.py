"""Benchmark decontamination by a prefix-filtered set join (dealt operator 7).

An item's windows (``width`` consecutive words, or all words of a shorter item) are sets of tokens
ordered by rarity among the items.  A document that contains a window contains its rarest word, so
that prefix of one token is all that is joined.  A match gives the place where the window would
have to start; the length and position bounds (it must lie in the document) and the window's exact
word sequence (two 64-bit hashes over word hashes) decide.

The items' index is broadcast when the measured size of their texts is within ``broadcast_bytes``.
Beyond that, blocks of documents send their distinct words to ranges of word hashes, where they meet
the windows with that prefix, and get back the windows to verify; results are the same.

Defined cases: a null or empty text has no words and an item without words no window; an item whose
id is null marks words but is not listed; items that share an id count once; repeated documents are
judged each; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm import blocks as B
from revlens.llm.arrays import ALNUM, P_WORD, P_WORD2, U, Texts, Words, hash_spans, run_starts, spread, word_hash, words_of

WIDTH = 10
BROADCAST_BYTES = 4 << 20
COUNTS, WINDOWS = 1, 2
#: What is judged: rows of the block, words, hit words, (row, item) pairs, item ids.
Finish = Callable[[pa.Table, Words, np.ndarray, np.ndarray, np.ndarray, list], pa.Table]


def _read(t: pa.Table, text: str) -> tuple[Words, np.ndarray]:
    texts = Texts.of(t[text]).lowered()
    w = words_of(texts, ALNUM)
    return w, word_hash(texts, w)


def _hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return hash_spans(h, start, end, P_WORD), hash_spans(h, start, end, P_WORD2)


def _sum(items, sender):
    name, count = items
    order = np.argsort(name, kind="stable")
    group = np.cumsum(run_starts(name[order])) - 1
    out = np.zeros(len(name), np.uint32)
    out[order] = np.bincount(group, count[order]).astype(np.uint32)[group] if len(name) else 0
    return out


def _index(benchmark: DataFrame, item_col: str, text_col: str, width: int, n: int) -> DataFrame:
    """Windows as packed rows by the range of their rarest word: that word, the window's place before
    it, length and hashes, and the item."""
    items = B.pack(B.chosen(benchmark, item_col, text_col), text_col)

    def send(block, t):
        names, count = np.unique(_read(t, text_col)[1], return_counts=True)
        return B.sends(block, n, names, count.astype(np.uint32))

    def windows(block, t, marks):
        w, h = _read(t, text_col)
        names, index = np.unique(h, return_inverse=True)
        count = B.answers(marks, COUNTS, len(names), np.uint32)[index].astype(np.int64)
        rank = np.empty(len(h), np.int64)  # rare first, then long, then by hash
        rank[np.lexsort((h, w.start - w.end, count))] = np.arange(len(h))
        size = np.minimum(w.per_doc, width)
        many = np.where(w.per_doc > 0, w.per_doc - size + 1, 0)
        item = np.repeat(np.arange(t.num_rows), many)
        start = w.first[item] + np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
        length = size[item]
        best = start.copy()
        for j in range(1, width):
            i = np.flatnonzero(j < length)
            i = i[rank[start[i] + j] < rank[best[i]]]
            best[i] = start[i] + j
        a, b = _hashes(h, start, start + length)
        order = np.argsort(h[best], kind="stable")
        ids = np.frombuffer(json.dumps(t[item_col].to_pylist()).encode(), np.uint8)
        return B.sends(block, n, *(x[order] for x in (h[best], (best - start).astype(np.uint8), length.astype(np.uint8), a, b, item.astype(np.uint32))), beside=lambda *_: [ids])

    counts = B.meet(B.each_block(items, send, B.SENT), _sum, COUNTS)
    return B.with_answers(items, counts, windows, B.SENT)


def _join_bodies(bodies: list[bytes]) -> tuple[list[np.ndarray], list]:
    """Windows of several packed rows, sorted by prefix word, and the item ids that they point to."""
    parts, ids = [], []
    for body in bodies:
        *x, text = B.load(body)
        x[5] = x[5].astype(np.int64) + len(ids)
        ids += json.loads(text.tobytes())
        parts.append(x)
    if not parts:
        z = np.zeros(0, U)
        return [z, z.astype(np.int64), z.astype(np.int64), z, z, z.astype(np.int64)], []
    all_of = [np.concatenate(x) for x in zip(*parts)]
    order = np.argsort(all_of[0], kind="stable")
    return [x[order] for x in all_of], ids


def _judge(w: Words, h: np.ndarray, index: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hit words, and distinct (row, item) pairs."""
    token, before, length, a, b, item = index
    if not len(token) or not len(h):
        return np.zeros(len(h), bool), np.zeros((0, 2), np.int64)
    maybe = np.zeros(1 << 16, bool)
    maybe[(token & U(0xFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(maybe[(h & U(0xFFFF)).astype(np.int64)])
    lo, hi = np.searchsorted(token, h[at]), np.searchsorted(token, h[at], "right")
    some = hi > lo
    at, lo, many = at[some], lo[some], (hi - lo)[some]
    word = np.repeat(at, many)
    k = np.repeat(lo, many) + np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many)
    start = word - before[k].astype(np.int64)
    end = start + length[k].astype(np.int64)
    row = w.doc[word]
    inside = (start >= w.first[row]) & (end <= w.first[row + 1])
    start, end, k, row = start[inside], end[inside], k[inside], row[inside]
    got_a, got_b = _hashes(h, start, end)
    equal = (got_a == a[k]) & (got_b == b[k])
    start, end, k, row = start[equal], end[equal], k[equal], row[equal]
    pairs = np.unique(np.stack([row, item[k]], 1), axis=0) if len(k) else np.zeros((0, 2), np.int64)
    return spread(len(h), start, end), pairs


def judged(docs: DataFrame, benchmark: DataFrame, finish: Finish, schema: str, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    spark = docs.sparkSession
    n = B.ranges(spark)
    index = _index(benchmark, item_col, item_text, width, n)
    size = benchmark.agg(F.sum(F.octet_length(F.col(f"`{item_text}`").cast("string")))).first()[0] or 0
    if size <= broadcast_bytes:
        held = spark.sparkContext.broadcast(_join_bodies([bytes(r.body) for r in index.select("body").collect()]))

        def run(batches):
            found, ids = held.value
            for b in B.slices(batches, text_col):
                t = pa.Table.from_batches([b])
                w, h = _read(t, text_col)
                yield from finish(t, w, *_judge(w, h, found), ids).to_batches()

        return B.map_rows(docs, run, schema)

    blocks = B.pack(docs, text_col)

    def send(block, t):
        return B.sends(block, n, np.unique(_read(t, text_col)[1]))

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        index, ids = _join_bodies([x.as_py() for x in right["body"]])
        rows = []
        for block, body in zip(left["block"].to_pylist(), left["body"] if len(index[0]) else []):
            (names,) = B.load(body.as_py())
            k = np.flatnonzero(np.isin(index[0], names))
            if len(k):
                used, again = np.unique(index[5][k], return_inverse=True)
                text = np.frombuffer(json.dumps([ids[i] for i in used]).encode(), np.uint8)
                rows.append((block, WINDOWS, 0, B.dump(*(x[k] for x in index[:5]), again.astype(np.uint32), text)))
        return B.table(B.ANSWER, rows)

    def apply(block, t, marks):
        w, h = _read(t, text_col)
        found, ids = _join_bodies([x.as_py() for x in marks["body"]])
        return finish(t, w, *_judge(w, h, found), ids)

    sent = B.each_block(blocks, send, B.SENT)
    answers = sent.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(join, B.ANSWER)
    return B.with_answers(blocks, answers, apply, schema)


def digest(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""

    def finish(t, w, hit, pairs, ids):
        listed: dict[int, set] = {}
        for row, item in pairs.tolist():
            if ids[item] is not None:
                listed.setdefault(row, set()).add(str(ids[item]))
        n_hit = np.diff(np.append(0, np.cumsum(hit))[w.first])
        named = [",".join(sorted(listed.get(i, ()))) for i in range(t.num_rows)]
        return pa.table({"doc_id": t["doc_id"].cast(pa.int64()), "n_words": w.per_doc, "n_hit": n_hit, "n_items": pa.array([len(listed.get(i, ())) for i in range(t.num_rows)], pa.int64()), "items_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in named], "contaminated": n_hit > 0})

    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return judged(B.chosen(docs, "doc_id", "text"), benchmark, finish, schema, width=width, broadcast_bytes=broadcast_bytes)


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without documents that contain a window of an item."""

    def finish(t, w, hit, pairs, ids):
        n_hit = np.diff(np.append(0, np.cumsum(hit))[w.first])
        return t.filter(pa.array(n_hit == 0))

    return judged(docs, benchmark, finish, docs.schema, text_col, width=width)
