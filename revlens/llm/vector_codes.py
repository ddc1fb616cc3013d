"""Vector code compression with a GNAT over the codebook's entries (dealt operator 11).

A vector's components become integers, the vector is cut into ``parts`` equal pieces, and every piece
is named by the nearest entry of its position's codebook: some bytes stand for the vector.  Codebooks
are refined in rounds; each takes the mean of the pieces that chose an entry.

Nearest entries are found in a GNAT (geometric near-neighbour access tree), one for each codebook:
some entries are split points, every other entry belongs to its nearest split point, and each pair of
split point and child keeps the range of distances from one to all of the other.  A query measures its
distance to the split points; where its distance to a split point, give or take the best distance that
it has, lies outside of a child's range, nothing in that child can be nearer, and the whole subtree is
left out.  The test is strict and its distances are rounded outwards, so an entry that ties is always
reached, and ties are decided by squared distances in integers, then by the lower index.

On Spark: the kept vectors are read once per round, each task sends the integer sums and counts of its
pieces (a row of fixed size for each position), and a tree of groups adds them, so that what meets in
one task grows with the square root of the number of tasks.  The driver holds the codebooks only
(``entries`` x dimension numbers), which every task needs.

Defined cases: a row is left out if its vector is null, empty, of another length than that of the
smallest kept id, or holds a null, NaN or infinite component; a length that ``parts`` does not divide
is an error, as is a component beyond 2**15 in size (squared distances would leave 64 bits); with
fewer vectors than ``entries`` a codebook has as many entries as there are vectors; rows that share an
id are ordered by their components, and a null id comes last; equal entries are told apart by index
(the lower one is chosen); an empty table gives an empty result.  Other columns of the table, whatever
their names, are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from revlens.llm import blocks as B

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
LIMIT = 1 << 15
#: Split points of a node, and the size up to which a node is a list of entries.
SPLITS = 16
LEAF = 24
#: Pieces that go through a tree together.
AT_ONCE = 1 << 14


def exact_kind(*arrays: np.ndarray):
    """float64 while every number of a squared distance stays below 2**53, else 64-bit integers."""
    most = max(int(np.abs(a).max(initial=0)) for a in arrays)
    return np.float64 if 4 * most * most * max(arrays[0].shape[1], 1) < 1 << 53 else np.int64


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all of b: exact for numbers of ``exact_kind``."""
    d = a @ b.T
    d *= -2
    d += (a * a).sum(1)[:, None]
    d += (b * b).sum(1)
    return d


def _down(d: np.ndarray) -> np.ndarray:
    """A number that is surely not above the root of an integer."""
    return np.sqrt(d, dtype=np.float64) * (1 - 1e-12) - 1e-9


def _up(d: np.ndarray) -> np.ndarray:
    """A number that is surely not below the root of an integer."""
    return np.sqrt(d, dtype=np.float64) * (1 + 1e-12) + 1e-9


@dataclass
class Node:
    entries: np.ndarray  # indices: of the split points, or of all entries of a leaf
    low: np.ndarray | None = None  # [child, split]: least distance from a split point to the child's entries
    high: np.ndarray | None = None
    children: list[Node | None] = field(default_factory=list)


class Gnat:
    """Nearest entry of a codebook for many queries; ``measured`` counts the distances that were computed."""

    def __init__(self, book: np.ndarray, splits: int = SPLITS, leaf: int = LEAF):
        self.book, self.splits, self.leaf, self.measured = book, splits, leaf, 0
        self.root = self._build(np.arange(len(book)))

    def _build(self, own: np.ndarray) -> Node:
        if len(own) <= max(self.leaf, self.splits):
            return Node(own)
        book = self.book[own].astype(exact_kind(self.book))
        between = squared(book, book)
        chosen, near = [0], between[0].copy()
        while len(chosen) < self.splits and near.max() > 0:  # each next one is far from those chosen
            chosen.append(int(near.argmax()))
            near = np.minimum(near, between[chosen[-1]])
        if len(chosen) == 1:  # all entries are equal
            return Node(own)
        chosen.sort()
        home = between[:, chosen].argmin(1)
        home[chosen] = -1
        low, high, children = np.full((len(chosen),) * 2, np.inf), np.full((len(chosen),) * 2, -np.inf), []
        for j in range(len(chosen)):
            inside = np.flatnonzero(home == j)
            if len(inside):
                to = between[np.ix_(chosen, inside)]
                low[j], high[j] = _down(to.min(1)), _up(to.max(1))
            children.append(self._build(own[inside]) if len(inside) else None)
        return Node(own[chosen], low, high, children)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of every query; of those that tie the lowest index."""
        kind = exact_kind(queries, self.book)
        index, best = np.empty(len(queries), np.int64), np.empty(len(queries), np.int64)
        for a in range(0, len(queries), AT_ONCE):
            q = queries[a : a + AT_ONCE].astype(kind)
            i, d = np.full(len(q), len(self.book)), np.full(len(q), np.inf if kind is np.float64 else np.iinfo(np.int64).max, kind)
            self._visit(self.root, q, self.book.astype(kind), np.arange(len(q)), i, d)
            index[a : a + AT_ONCE], best[a : a + AT_ONCE] = i, d.astype(np.int64)
        return index, best

    def _visit(self, node: Node, queries, book, ask, index, best) -> None:
        d = squared(queries[ask], book[node.entries])
        self.measured += d.size
        at = np.arange(len(ask))
        which = d.argmin(1)  # the entries of a node are in the order of their indices
        least, which = d[at, which], node.entries[which]
        old, old_index = best[ask], index[ask]
        better = (least < old) | ((least == old) & (which < old_index))
        best[ask[better]], index[ask[better]] = least[better], which[better]
        if not node.children:
            return
        low, high = _down(d), _up(d)
        for k in np.argsort(d, axis=1, kind="stable").T:  # each query's nearest child first, then the next one
            reach = _up(best[ask])[:, None]
            # strictly: an entry that ties is reached
            open_ = ((low - reach <= node.high[k]) & (high + reach >= node.low[k])).all(1)
            order = np.flatnonzero(open_)
            order = order[np.argsort(k[order], kind="stable")]
            ends = np.cumsum(np.bincount(k[order], minlength=len(node.children)))
            for j, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
                if a < b and node.children[j] is not None:
                    self._visit(node.children[j], queries, book, ask[order[a:b]], index, best)


def vectors(table: DataFrame, vec_col: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """The named columns and ``_v``, the vector in integers, of rows whose vector is whole."""
    keep = keep or []
    t = B.chosen(table, *dict.fromkeys([*keep, vec_col]))
    v = F.col(vec_col)
    whole = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return t.where(F.coalesce(whole, F.lit(False))).select(*keep, F.transform(v, lambda x: F.floor(x.cast("double") * SCALE)).alias("_v"))


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    """Pieces [row, part, place] of a batch."""
    flat = np.asarray(column.flatten(), np.int64)
    if len(flat) and max(-int(flat.min()), int(flat.max())) >= LIMIT * SCALE:
        raise ValueError(f"a component of {LIMIT} or more does not fit 64-bit squared distances")
    return flat.reshape(len(column), parts, -1)


def start_books(kept: DataFrame, id_col: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES) -> list[np.ndarray]:
    """The pieces of the vectors with the smallest ids, for each position; empty if there are none."""
    first = kept.select(id_col, "_v").orderBy(F.col(id_col).asc_nulls_last(), F.col("_v")).limit(entries).collect()
    if not first:
        return []
    dim = len(first[0]["_v"])
    if dim % parts:
        raise ValueError(f"vectors of {dim} components are not cut into {parts} equal parts")
    got = np.array([r["_v"] for r in first if len(r["_v"]) == dim], np.int64).reshape(-1, parts, dim // parts)
    return [np.ascontiguousarray(got[:, p]) for p in range(parts)]


def _sized(kept: DataFrame, books: list[np.ndarray]) -> DataFrame:
    return kept.where(F.size("_v") == sum(b.shape[1] for b in books))


def _add(t: pa.Table) -> pa.Table:
    total = None
    for x in t["body"]:
        (own,) = B.load(x.as_py())
        total = own if total is None else total + own
    return pa.table({"lane": t["lane"][:1].cast(pa.int32()), "body": pa.array([B.dump(total)], pa.binary())})


def refine(kept: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: every piece chooses an entry, every entry becomes the mean (rounded down) of its pieces."""
    spark, parts = kept.sparkSession, len(books)
    n, width = len(books[0]), books[0].shape[1]
    held = spark.sparkContext.broadcast(books)

    def sums(batches):
        trees, total = [Gnat(b) for b in held.value], np.zeros((parts, n, width + 1), np.int64)
        for b in batches:
            m = _matrix(b.column(0), parts)
            for p in range(parts):
                index, _ = trees[p].nearest(m[:, p])
                order = np.argsort(index, kind="stable")
                heads = np.flatnonzero(np.append(True, np.diff(index[order]) > 0)[: len(order)])
                if len(heads):
                    total[p, index[order][heads], :width] += np.add.reduceat(m[order, p], heads, axis=0)
                    total[p, :, width] += np.bincount(index, minlength=n)
        if total[:, :, width].any():
            yield from pa.table({"lane": pa.array([TaskContext.get().partitionId()], pa.int32()), "body": pa.array([B.dump(total.reshape(-1))], pa.binary())}).to_batches()

    sent = kept.select("_v").mapInArrow(sums, "lane int, body binary")
    lanes = max(1, int(B.parts(spark) ** 0.5))  # as many rows meet in a lane as there are lanes
    sent = sent.withColumn("lane", F.col("lane") % lanes).groupBy("lane").applyInArrow(_add, "lane int, body binary")
    total = sum((B.load(bytes(r.body))[0] for r in sent.select("body").toLocalIterator()), np.zeros(parts * n * (width + 1), np.int64)).reshape(parts, n, width + 1)
    held.unpersist()
    return [np.where(t[:, width:] > 0, t[:, :width] // np.maximum(t[:, width:], 1), b) for t, b in zip(total, books)]


def train(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks (one for each part, [entry, place]) of a table; [] if it has no whole vector."""
    kept = vectors(table, vec_col, [id_col])
    books = start_books(kept, id_col, parts, entries)
    for _ in range(rounds if books else 0):
        books = refine(_sized(kept, books), books)
    return books


def encode(table: DataFrame, books: list[np.ndarray], keep: list[str], vec_col: str = "embedding") -> DataFrame:
    """``keep``, codes (indices as an array of ints, one for each part) and error (squared distance) of every whole vector."""
    kept = _sized(vectors(table, vec_col, keep), books)
    held, parts = kept.sparkSession.sparkContext.broadcast(books), len(books)

    def run(batches):
        trees = [Gnat(b) for b in held.value]
        for b in batches:
            m = _matrix(b.column(b.num_columns - 1), parts)
            found = [t.nearest(m[:, p]) for p, t in enumerate(trees)]
            codes = np.stack([i for i, _ in found], 1).astype(np.int32).reshape(-1)
            error = sum((d for _, d in found), np.zeros(len(m), np.int64))
            off = pa.array(np.arange(len(m) + 1) * parts, pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(off, pa.array(codes)), pa.array(error)], names)

    names = [*keep, "codes", "error"]
    kinds = dict(kept.dtypes)
    return kept.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", codes array<int>, error long")


def decode(coded: DataFrame, books: list[np.ndarray], to: str = "decoded", codes_col: str = "codes") -> DataFrame:
    """``coded``, all columns, and the vectors that the codes stand for, in the components' own scale."""
    held = coded.sparkSession.sparkContext.broadcast(books)
    rest = [f for f in coded.schema.fields if f.name != to]
    at = [f.name for f in rest].index(codes_col)

    def run(batches):
        for b in batches:
            codes = np.asarray(b.column(at).flatten(), np.int64).reshape(b.num_rows, len(held.value))
            v = np.concatenate([book[codes[:, p]] for p, book in enumerate(held.value)], 1) / SCALE
            off = pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(off, pa.array(v.reshape(-1)))], [*b.schema.names, to])

    return B.map_rows(coded.select(*(f.name for f in rest)), run, StructType([*rest, StructField(to, ArrayType(DoubleType()))]))


def books_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def digest(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every whole vector."""
    books = train(table, id_col, vec_col)
    coded = encode(table, books, [id_col, label_col], vec_col) if books else vectors(table, vec_col, [id_col, label_col]).select(
        id_col, label_col, F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"))
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    # a written table: two consumers, and distances are not searched again
    coded = coded.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("_label"), code.alias("code"), "error").checkpoint()
    by_label = coded.groupBy("_label").agg(F.sum("error").alias("label_error")).withColumnRenamed("_label", "_of")
    return coded.join(by_label, F.col("_label").eqNullSafe(F.col("_of"))).select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
