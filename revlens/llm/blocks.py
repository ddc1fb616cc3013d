"""Corpus blocks: several MB of rows as one compressed value, and keys exchanged between blocks.

Most operators here ask of every item of a text (word, window, phrase, shingle) something that
depends on the whole corpus: how often it occurs, in which document first.  Exploding texts into
one Spark row per item would shuffle many times the corpus.  Instead

* ``pack`` turns the table into blocks of about ``BLOCK_BYTES`` of text and deals them by block
  number.  Every consumer reads that one exchange (Spark reuses it), so the texts move once;
* a block sends its *distinct* items, sorted, as one packed row for each range of hashes
  (``sends``); a range meets in one group (``meet``), whose size is the corpus over the number of
  ranges however often one item occurs, since a block sends an item once;
* the answer returns as packed bits in the order in which the block sent its items (``answers``),
  and the block, when read again, works out the same items and applies them.

The input has to be replayable (a table, or a checkpoint), as for any Spark job that may lose
executors: a block recomputed after a loss must hold the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from revlens.functions.memory import give_back

BLOCK_BYTES = 3 << 20
SENT = "bucket int, block long, start long, body binary"
ANSWER = "block long, kind int, start long, body binary"
_ZSTD = pa.Codec("zstd", 1)
U = np.uint64


def parts(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ranges(spark: SparkSession) -> int:
    """Number of hash ranges: sized with the shuffle, as that is sized with the data."""
    return 3 * parts(spark)


def dump(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed value; bytes of equal weight stand together, and sorted 64-bit
    numbers as differences, so that what is predictable costs little."""
    out = [np.array([len(arrays)], np.int32).tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a)
        diff = a.dtype == U and len(a) > 1 and bool((a[1:] >= a[:-1]).all())
        planes = (np.diff(a, prepend=a.dtype.type(0)) if diff else a).view(np.uint8).reshape(len(a), -1 if len(a) else 1).T
        raw = np.ascontiguousarray(planes)  # many times faster than tobytes of the transposed view
        packed = pa.Codec("zstd", level).compress(raw, asbytes=True) if raw.size else b""
        out += [np.array([len(a), len(packed), raw.nbytes, diff], np.int64).tobytes(), a.dtype.str.ljust(8).encode(), packed]
    return b"".join(out)


def load(body: bytes) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(body, np.int32, 1)[0]), 4, []
    for _ in range(n):
        length, size, raw, diff = np.frombuffer(body, np.int64, 4, at).tolist()
        dtype = np.dtype(body[at + 32 : at + 40].decode().strip())
        at += 40
        if length:
            planes = np.frombuffer(_ZSTD.decompress(body[at : at + size], raw, asbytes=True), np.uint8).reshape(dtype.itemsize, length)
            a = np.empty((length, dtype.itemsize), np.uint8)
            for k in range(dtype.itemsize):
                a[:, k] = planes[k]
            a = a.view(dtype).reshape(-1)
        else:
            a = np.zeros(0, dtype)
        out.append(np.cumsum(a, dtype=U) if diff else a)
        at += size
    return out


def task_gives_back(fn: Callable) -> Callable:
    """For ``mapInArrow``: ``fn``, and ``give_back`` when it has ended and so holds nothing itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return run


def group_gives_back(fn: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """For ``applyInArrow``: the same after every group."""

    def run(t: pa.Table) -> pa.Table:
        out = fn(t)
        give_back()
        return out

    return run


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all().combine_chunks()


def pack(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, payload): all columns of ``docs``, rows in their order; ``text`` sizes the blocks.

    A row longer than ``block_bytes`` is a block of its own.  An empty table has no blocks.
    """

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def block():
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([pa.array([base + seq], pa.int64()), pa.array([_ipc(t)], pa.binary())], ["block", "payload"])

        for b in batches:
            lengths = np.asarray(pc.binary_length(b.column(b.schema.get_field_index(text))).fill_null(0), np.int64)
            first = 0
            for i, n in enumerate(lengths.tolist()):
                size += n + 16
                if size >= block_bytes:
                    held.append(b.slice(first, i + 1 - first))
                    yield block()
                    seq, held, size, first = seq + 1, [], 0, i + 1
            if first < b.num_rows:
                held.append(b.slice(first))
        if held:
            yield block()

    return map_rows(docs, fn, "block long, payload binary").repartition(parts(docs.sparkSession), "block")


def map_rows(docs: DataFrame, fn: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` that also takes columns whose names differ in case only."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(pa.RecordBatch.from_arrays(b.columns, names) for b in batches)

    return docs.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(task_gives_back(run), schema)


def slices(batches: Iterator[pa.RecordBatch], text_col: str, size: int = BLOCK_BYTES // 2) -> Iterator[pa.RecordBatch]:
    """Batches of about ``size`` bytes of text; a longer text is alone."""
    for b in batches:
        lengths = np.asarray(pc.binary_length(b.column(b.schema.get_field_index(text_col))).fill_null(0), np.int64)
        first, held = 0, 0
        for i, n in enumerate(lengths.tolist()):
            held += n
            if held >= size:
                yield b.slice(first, i + 1 - first)
                first, held = i + 1, 0
        if first < b.num_rows:
            yield b.slice(first)


def cut(names: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """(range, from, to) of sorted hashes, for n equal ranges of 64-bit numbers."""
    edges = np.array([(i << 64) // n for i in range(1, n)], U)
    at = [0, *np.searchsorted(names, edges).tolist(), len(names)]
    return ((i, at[i], at[i + 1]) for i in range(n) if at[i + 1] > at[i])


def table(schema: str, rows: list[tuple]) -> pa.Table:
    names, kinds = zip(*(c.strip().split(" ") for c in schema.split(",")))
    to = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    cols = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.table({n: pa.array(list(c), to[k]) for n, k, c in zip(names, kinds, cols)})


def sends(block: int, n: int, names: np.ndarray, *more: np.ndarray, beside: Callable[[int, int], list] | None = None) -> pa.Table:
    """A block's distinct items, sorted by their hash, as packed rows by range; ``more`` has arrays
    along them, ``beside(a, b)`` gives further ones for items a to b (bytes of strings)."""
    return table(SENT, [(i, block, a, dump(names[a:b], *(m[a:b] for m in more), *(beside(a, b) if beside else ()))) for i, a, b in cut(names, n)])


def each_block(blocks: DataFrame, fn: Callable[[int, pa.Table], pa.Table], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, payload in zip(b.column(0).to_pylist(), b.column(1)):
                yield from fn(block, unpack(payload.as_py())).to_batches()
                give_back()

    return blocks.select("block", "payload").mapInArrow(run, schema)


def meet(sent: DataFrame, fn: Callable[[list[np.ndarray], np.ndarray], np.ndarray], kind: int) -> DataFrame:
    """Joins what blocks sent for a range.  ``fn`` gets the arrays, end to end, and the number of the
    sender of each item; it returns a bool or unsigned integer for each item.  Rows of zeros are left out."""

    def run(t: pa.Table) -> pa.Table:
        bodies = [load(x.as_py()) for x in t["body"]]
        lengths = [len(x[0]) for x in bodies]
        got = fn([np.concatenate(x) for x in zip(*bodies)], np.repeat(np.arange(len(bodies)), lengths))
        rows, at = [], 0
        for block, start, n in zip(t["block"].to_pylist(), t["start"].to_pylist(), lengths):
            part, at = got[at : at + n], at + n
            if part.any():
                rows.append((block, kind, start, dump(np.packbits(part) if part.dtype == bool else part)))
        return table(ANSWER, rows)

    spark = sent.sparkSession
    return sent.groupBy("bucket").applyInArrow(group_gives_back(run), ANSWER).repartition(parts(spark), "block")


def answers(marks: pa.Table, kind: int, n: int, dtype=bool) -> np.ndarray:
    """What came back for a block's n items, in the order in which it sent them."""
    out = np.zeros(n, dtype)
    for k, start, body in zip(marks["kind"].to_pylist(), marks["start"].to_pylist(), marks["body"]):
        if k == kind:
            (x,) = load(body.as_py())
            x = np.unpackbits(x)[: n - start].astype(bool) if dtype is bool else x
            # the last byte of a bit set may run into the next range
            out[start : start + len(x)] = (out[start : start + len(x)] | x) if dtype is bool else x
    return out


def with_answers(blocks: DataFrame, marks: DataFrame, fn: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str | StructType) -> DataFrame:
    """``fn(block, rows, marks)`` for every block; a block without marks gets an empty table."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (block,), (payload,) = left["block"].to_pylist(), left["payload"].to_pylist()
        out = fn(block, unpack(payload), right)
        give_back()
        return out

    return blocks.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(run, schema)


def ids_of(t: pa.Table, name: str) -> np.ndarray:
    """Document numbers for comparisons; a null one comes after all others."""
    return np.asarray(t[name].combine_chunks().cast(pa.int64()).fill_null(np.iinfo(np.int64).max), np.int64) if t.num_rows else np.zeros(0, np.int64)


def chosen(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; by exact name where others differ in case only."""
    at = [docs.columns.index(n) for n in names]
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).select(*(F.col(f"c{i}").alias(n) for i, n in zip(at, names)))
