"""LM scoring with a hashed maximum-entropy model (dealt operator 1).

Tokens are a text's lower-cased words and one end.  A token's probability is factored by classes
(octaves of the training count; 0: seen once or never), and tilted by the weight of the n-gram it
ends:

    P0(token | before) = softmax over classes(weights of hashed features) * P(token | class)
    P(token | before)  = P0(token | before) * exp(weight of (last, token)) / Z(last)

* Class features are the two tokens before as a pair, the last one, and the one before it alone (a
  skip); each is hashed to a row of one table of ``FEATURES`` x ``CLASSES`` weights.  Within a class
  a token has its share of the class's training tokens; class 0 is even over its words and one place
  for all unseen ones.
* Word features are all pairs (last token, token) of the training texts, hashed to a table that grows
  with the corpus: 32 bits in each hash range, whose number follows the data.  Their weights are
  log(1 + c / (m P0)), c the pair's count, so that Z is 1 + n / m, n the count of the last token, and
  nothing has to be summed over the vocabulary.  ``m`` says how much evidence a pair needs; there is
  one for each class of the last token.  A text's first token follows an end.

1. Blocks send their distinct tokens and pairs with training counts, ranges add them up over the
   corpus, and blocks get the sums back.  Blocks are then coded (tokens by number, counts of tokens
   and of each token's pair) and checkpointed.
2. Class weights start from the features' class counts (a distributed sum over all training texts);
   then ``ROUNDS`` synchronous updates over all training texts follow.  In each, tasks add up observed
   and expected class counts of every feature in sparse numpy batches, and the gradient of the
   ``m`` (a token is left out of its own pair's count there); shards are summed in ranges, and the
   driver, which holds the class weights and the ``m`` only, steps along the gradient, scaled by the
   expected counts.
3. All texts are scored in the same batches.

Defined cases: a null or empty text is its end alone; a very long text is one block and is scored
whole; a null number counts as the empty one (for the held-out rule); repeated rows all count; other
columns are not read, whatever their names; a corpus without training documents gives every base
score 0; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm import blocks as B
from revlens.llm.arrays import PLAIN, U, Texts, mix, run_starts, word_hash, words_of

CLASSES = 32
FEATURES = 1 << 13  # a power of two, at most 2^16
ROUNDS = 2
STEP = 0.5
EVIDENCE = 4.0  # first value of every m
START = 0.45  # share of each feature's own log ratio in its first weight; three features meet
PRIOR = 4.0
RIDGE = 8.0
SHARDS = 16
FAN = 64
TINY = np.float32(1e-37)  # least class probability whose logarithm is taken
BATCH = 1 << 16
STRETCH = 1 << 11  # tokens whose probabilities are worked out or added up at a time: they stay in the processor's cache
HELD_OUT = (7, 2)
END = U(0x452821E638D01377)
COUNTS, STATS, PAIRS = 1, 2, 3
PAIR_KEY = U(0x9FB21C651E98DF25)
SUMS = B.ANSWER + ", types long, tokens long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(ids: pa.Array) -> np.ndarray:
    crc = np.array([zlib.crc32(b"" if i is None else str(i).encode()) for i in ids.to_pylist()], np.int64)
    return crc % HELD_OUT[0] == HELD_OUT[1]


def class_of(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(np.maximum(count, 1))), CLASSES - 1).astype(np.uint8)


def _tokens(t: pa.Table):
    """Hashes of all tokens (each row's words, then its end), and the index of each row's first."""
    texts = Texts.of(t["text"]).lowered()
    w = words_of(texts, PLAIN)
    first = w.first + np.arange(t.num_rows + 1)
    out = np.full(int(first[-1]), END, U)
    out[np.arange(len(w.doc)) + w.doc] = word_hash(texts, w)
    return out, first


def _pairs(tokens: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Hashes of (last token, token), as many bits as 32 in each of n ranges take (whole bytes)."""
    last = np.roll(tokens, 1)
    last[first[:-1]] = END
    bits = min(64, -(-(32 + n.bit_length()) // 8) * 8)
    return mix(mix(last ^ PAIR_KEY) + tokens) & U((1 << 64) - (1 << 64 - bits))


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in 32 bits where all of them fit."""
    return counts.astype(np.uint32 if not len(counts) or counts.max() < 1 << 32 else U)


def _add_up(t: pa.Table, n: int) -> pa.Table:
    """Sums of a range's counts; ranges from n on are those of pairs."""
    kind = COUNTS if t["bucket"][0].as_py() < n else PAIRS
    bodies = [B.load(x.as_py()) for x in t["body"]]
    name, count = (np.concatenate(x) for x in zip(*bodies))
    order = np.argsort(name)  # sums of whole numbers: equal names in any order
    heads = run_starts(name[order])
    group = np.cumsum(heads) - 1
    total = np.bincount(group, count[order])
    of = np.empty(len(name), np.int64)
    of[order] = total[group]
    rows, at = [], 0
    for block, start, x in zip(t["block"].to_pylist(), t["start"].to_pylist(), bodies):
        rows.append((block, kind, start, B.dump(_narrow(of[at : at + len(x[0])])), 0, 0))
        at += len(x[0])
    if kind == PAIRS:
        return B.table(SUMS, rows)
    kinds = class_of(total)
    types = np.bincount(kinds[total > 0], minlength=CLASSES)
    tokens = np.bincount(kinds, total, CLASSES)
    rows += [(-1, STATS, k, b"", int(types[k]), int(tokens[k])) for k in range(CLASSES) if types[k]]
    return B.table(SUMS, rows)


def _features(word: np.ndarray, first: np.ndarray, number: np.ndarray | None = None) -> list[np.ndarray]:
    """Rows of the weights for every token: last token, pair of last tokens, the one before the last.
    ``word`` has every token, or the distinct ones with each token's ``number`` among them: what one
    word decides is hashed once a word."""
    number = np.arange(len(word)) if number is None else number.astype(np.int64)
    back1, back2 = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)  # 0: none
    back1[1:], back2[2:] = number[:-1] + 1, number[:-2] + 1
    start = first[:-1]
    back1[start] = back2[start] = 0
    second = start[np.diff(first) > 1] + 1
    back2[second] = 0
    word = np.append(U(0), word)
    hashed = lambda kind, x: (mix(x * U(4) + U(kind)) & U(FEATURES - 1)).astype(np.int64)
    return [hashed(0, word)[back1], hashed(1, mix(word)[back1] + word[back2]), hashed(2, word)[back2]]


def _log_probabilities(weights: np.ndarray, bias: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    return np.log(np.maximum(_probabilities(weights, bias, rows), TINY))


def _probabilities(weights: np.ndarray, bias: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    out = np.empty((len(rows[0]), len(bias)), np.float32)
    for a in range(0, len(out), STRETCH):
        x = weights.take(rows[0][a : a + STRETCH], 0)
        x += weights.take(rows[1][a : a + STRETCH], 0)
        x += weights.take(rows[2][a : a + STRETCH], 0)
        x += bias
        x -= np.ascontiguousarray(x.T).max(0)[:, None]  # a maximum along short rows is slow
        np.exp(x, out=x)
        np.divide(x, x.sum(1, keepdims=True), out=out[a : a + STRETCH])
    return out


def _sum_rows(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    order = np.argsort(rows.astype(np.uint16), kind="stable")  # numpy sorts 16-bit numbers by radix
    rows = rows[order]
    heads = np.flatnonzero(run_starts(rows))
    at, edges = rows[heads], np.append(heads, len(rows))
    cuts = np.unique(np.append(np.searchsorted(heads, np.arange(0, len(rows), STRETCH)), len(heads))).tolist()
    for a, b in zip(cuts[:-1], cuts[1:]):  # whole rows, as reduceat goes over its input once a column
        into[at[a:b]] += np.add.reduceat(values.take(order[edges[a] : edges[b]], 0), heads[a:b] - edges[a])


def _shard_sums(coded: DataFrame, per_block, n_arrays: int, classes: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sums over all blocks of ``n_arrays`` float arrays (FEATURES x classes), which tasks add up for
    theirs, and of one (2 x CLASSES)."""

    def run(batches):
        total = [np.zeros((FEATURES, classes), np.float64) for _ in range(n_arrays)]
        small = np.zeros((2, CLASSES))
        for b in batches:
            for body in b.column(0):
                per_block(B.load(body.as_py()), total, small)
        size = FEATURES // SHARDS
        task = TaskContext.get().partitionId()
        rows = [(s, task, 0, B.dump(*(x[s * size : (s + 1) * size].astype(np.float32).reshape(-1) for x in total))) for s in range(SHARDS)]
        rows.append((SHARDS, task, 0, B.dump(small.reshape(-1))))
        yield from B.table(B.SENT, rows).to_batches()

    def add(t: pa.Table) -> pa.Table:
        by_task = sorted(zip(t["block"].to_pylist(), t["body"].to_pylist()))  # one order of adding, one result
        total = None
        for _, body in by_task:
            got = [x.astype(np.float64) for x in B.load(body)]
            total = got if total is None else [a + b for a, b in zip(total, got)]
        return B.table(B.SENT, [(t["bucket"][0].as_py(), 0, 0, B.dump(*total))])

    # a tree in two levels: FAN groups of tasks a shard, then the groups' sums
    near = coded.select("body").mapInArrow(run, B.SENT).groupBy("bucket", (F.col("block") % FAN).alias("fan"))
    near = near.applyInArrow(lambda key, t: add(t).set_column(1, "block", pa.array([key[1].as_py()], pa.int64())), B.SENT)
    shards = near.groupBy("bucket").applyInArrow(add, B.SENT).collect()
    parts = [B.load(bytes(r.body)) for r in sorted(shards, key=lambda r: r.bucket)]
    if not parts:
        return [np.zeros((FEATURES, classes)) for _ in range(n_arrays)], np.zeros((2, CLASSES))
    return [np.concatenate(x).reshape(FEATURES, classes) for x in zip(*parts[:-1])], parts[-1][0].reshape(2, CLASSES)


def code(docs: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Coded blocks (a checkpoint), and the classes' training types and tokens."""
    blocks = B.pack(B.chosen(docs, "doc_id", "text"))
    n = B.ranges(blocks.sparkSession)

    def send(block, t):
        tokens, first = _tokens(t)
        train = np.repeat(~held_out(t["doc_id"]), np.diff(first))

        def counted(items, shift):
            names, index = np.unique(items, return_inverse=True)
            out = B.sends(block, n, names, np.bincount(index, train, len(names)).astype(np.uint32))
            return out.set_column(0, "bucket", pc.add(out["bucket"], pa.scalar(shift, pa.int32())))

        return pa.concat_tables([counted(tokens, 0), counted(_pairs(tokens, first, n), n)])

    sums = B.each_block(blocks, send, B.SENT).groupBy("bucket").applyInArrow(lambda t: _add_up(t, n), SUMS).checkpoint()
    types, tokens = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sums.where(F.col("kind") == STATS).groupBy("start").agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).collect():
        types[r.start], tokens[r.start] = r.types, r.tokens
    size, words = int(tokens.sum()), int(types.sum())

    def coded(block, t, marks):
        hashes, first = _tokens(t)
        names, index = np.unique(hashes, return_inverse=True)
        count = B.answers(marks, COUNTS, len(names), U)
        pairs, pair = np.unique(_pairs(hashes, first, n), return_inverse=True)
        pair = B.answers(marks, PAIRS, len(pairs), U)[pair]
        order = np.argsort(-np.bincount(index, minlength=len(names)), kind="stable")  # small numbers for frequent ones
        number = np.empty(len(names), np.uint32)
        number[order] = np.arange(len(names), dtype=np.uint32)
        per = lambda x: np.add.reduceat(x, first[:-1]) if t.num_rows else np.zeros(0)
        base = per(np.log10((count.astype(np.float64) + 1) / (size + words + 1))[index])
        null = np.asarray(t["doc_id"].combine_chunks().is_null(), np.uint8)
        end = np.array([np.searchsorted(names, END)], np.int64)
        held = held_out(t["doc_id"]).astype(np.uint8)
        body = B.dump(B.ids_of(t, "doc_id"), null, held, np.diff(first), per((count > 0).astype(np.int64)[index]), base, _narrow(count[order]), (names[order] >> U(32)).astype(np.uint32), number[end], number[index], _narrow(pair))
        return pa.table({"block": pa.array([block], pa.int64()), "body": pa.array([body], pa.binary())})

    marks = sums.where(F.col("kind") != STATS).select("block", "kind", "start", "body").repartition(B.parts(blocks.sparkSession), "block")
    return B.with_answers(blocks, marks, coded, "block long, body binary").checkpoint(), types, tokens


class Block:
    """A coded block's tokens: number of the word, class, rows of features, counts of the pair and the last
    token, class of the last token; and its distinct words with count and class, from which tokens take theirs."""

    def __init__(self, arrays: list[np.ndarray]):
        self.ids, self.null, self.held, self.size, self.known, self.base, count, word, end, number, pair = arrays
        self.first = np.append(0, np.cumsum(self.size))
        self.words = count.astype(np.float64)
        self.kinds = class_of(self.words).astype(np.int64)
        self.number = number.astype(np.int64)
        self.cls = self.kinds[self.number]
        self.rows = _features(word.astype(U) + U(1), self.first, self.number)
        self.pair = pair.astype(np.float64)
        last = np.roll(self.number, 1)
        last[self.first[:-1]] = end[0]
        self.last, self.last_cls = self.words[last], self.kinds[last]
        self.train = np.repeat(self.held == 0, self.size)

    def batches(self, use: np.ndarray):
        at = np.flatnonzero(use)
        for a in range(0, len(at), BATCH):
            i = at[a : a + BATCH]
            yield i, [x[i] for x in self.rows]


def _inside(types: np.ndarray, tokens: np.ndarray, cls: np.ndarray, count: np.ndarray) -> np.ndarray:
    """log P(token | class)."""
    return np.where(cls > 0, np.log(np.maximum(count, 1) / np.maximum(tokens[cls], 1)), -np.log(types[0] + 1))


def _tilted(log_p0: np.ndarray, pair: np.ndarray, last: np.ndarray, m: np.ndarray) -> np.ndarray:
    """log P from log P0, the counts of the pair and of the last token, and the last token's m."""
    own = log_p0 + np.log(m)
    return np.logaddexp(own, np.log(np.maximum(pair, 1e-300))) - np.log(last + m)


def train(coded: DataFrame, types: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, bias) of the classes, float32, and m by class of the last token.  Classes above the most
    frequent token's have no weights; those below it that no token has get no probability."""
    sc = coded.sparkSession.sparkContext
    classes = int(np.flatnonzero(np.append(1, tokens[1:])).max()) + 1
    share = (tokens[:classes] + 0.5) / (tokens.sum() + 0.5 * classes)
    bias = np.where(np.append(1, tokens[1:classes]) > 0, np.log(share), -np.inf).astype(np.float32)

    def observed(arrays, total, _):
        x = Block(arrays)
        cls = x.cls[x.train]
        for r in x.rows:
            total[0] += np.bincount(r[x.train] * classes + cls, minlength=FEATURES * classes).reshape(FEATURES, classes)

    (seen,), _ = _shard_sums(coded, observed, 1, classes)
    ratio = np.log((seen + PRIOR * share) / (seen.sum(1, keepdims=True) + PRIOR)) - np.log(share)
    weights, log_m = (START * ratio).astype(np.float32), np.full(CLASSES, np.log(EVIDENCE))
    for _ in range(ROUNDS):
        held = sc.broadcast((weights, bias, log_m))

        def gradient(arrays, total, small, held=held):
            w, b, lm = held.value
            x = Block(arrays)
            inside, m_of = np.exp(_inside(types, tokens, x.kinds, x.words)), np.exp(lm)
            for i, rows in x.batches(x.train):
                expected = _probabilities(w, b, rows)
                c = x.cls[i]
                for r in rows:
                    _sum_rows(total[0], r, expected)
                # how the log probability moves with log m, the token itself left out of the counts
                k = x.last_cls[i]
                m = m_of[k]
                own = m * expected[np.arange(len(i)), c] * inside[x.number[i]]
                slope = own / (x.pair[i] - 1 + own) - m / (x.last[i] - 1 + m)
                small[0] += np.bincount(k, slope, CLASSES)
                small[1] += np.bincount(k, slope * slope, CLASSES)

        (expected,), small = _shard_sums(coded, gradient, 1, classes)
        weights = (weights + STEP * (seen - expected) / (expected + RIDGE)).astype(np.float32)
        log_m = log_m + np.clip(small[0] / (small[1] + 1), -2, 2)
        held.unpersist()
    return weights, bias, np.exp(log_m)


def scored(coded: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], types: np.ndarray, tokens: np.ndarray) -> DataFrame:
    held = coded.sparkSession.sparkContext.broadcast(model)
    size = int(tokens.sum())

    def run(batches):
        w, b, m = held.value
        for batch in batches:
            for body in batch.column(0):
                x = Block(B.load(body.as_py()))
                inside, log = _inside(types, tokens, x.kinds, x.words), np.empty(len(x.cls), np.float64)
                for i, rows in x.batches(np.ones(len(x.cls), bool)):
                    c = x.cls[i]
                    p0 = np.log(np.maximum(_probabilities(w, b, rows)[np.arange(len(i)), c], TINY)) + inside[x.number[i]]
                    log[i] = _tilted(p0, x.pair[i], x.last[i], m[x.last_cls[i]])
                score = np.add.reduceat(log, x.first[:-1]) / np.log(10) if len(x.ids) else np.zeros(0)
                yield from pa.table({
                    "doc_id": pa.array(x.ids, pa.int64(), mask=x.null.astype(bool)), "held_out": x.held.astype(bool), "n_tokens": x.size.astype(np.int64), "n_known": x.known.astype(np.int64),
                    "train_tokens": np.full(len(x.ids), size, np.int64), "base_score": x.base, "score": score,
                }).to_batches()

    return coded.select("body").mapInArrow(run, SCORES)


def score(docs: DataFrame) -> DataFrame:
    """Counts, base score and model score (log10) of every document, for a model of the training ones."""
    coded, types, tokens = code(docs)
    return scored(coded, train(coded, types, tokens), types, tokens)
