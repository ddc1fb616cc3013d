"""Transcript folding on a stream of chunks (T2, T3, T5 in streaming form).

State per conversation is three scalars - the type of the last message, the
number of messages so far and the epoch - so it stays small however long a
conversation runs.  Each incoming chunk is tagged with its epoch and message
number (append mode); the messages' text is the ordered concatenation of their
chunks, computed downstream.  A ``clear`` chunk starts a new epoch (T5) and is
passed on with it, so that :func:`last_epoch` can leave out what was cleared
even when nothing follows.

State is a value with a time to live (``transformWithState`` on RocksDB): that
of a conversation without chunks for ``timeout_ms`` expires on its own.  One
that returns starts an epoch numbered by its time, so that its messages cannot
meet earlier ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from revlens.streaming.state import use_rocksdb


class _Tagger(StatefulProcessor):
    """Tags a key's rows, in order; ``step(rows, state or None, epoch of a new state)`` gives (rows, state)."""

    def __init__(self, step, order: Sequence[str], columns: Sequence[str], state: T.StructType, timeout_ms: int | None):
        self.step, self.order, self.columns, self.schema, self.timeout_ms = step, list(order), list(columns), state, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("last", self.schema, ttlDurationMs=self.timeout_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="mergesort", ignore_index=True)
        state = tuple(self.held.get()) if self.held.exists() else None
        epoch = timerValues.getCurrentProcessingTimeInMs() if self.timeout_ms else 0
        tagged, state = self.step(pdf, state, epoch)
        self.held.update(state)
        yield tagged[self.columns]

    def close(self) -> None:
        pass


def _tagged(rows: DataFrame, key_col: str, step, order: Sequence[str], out: T.StructType, state: T.StructType, timeout_ms: int | None) -> DataFrame:
    use_rocksdb(rows.sparkSession)
    tagger = _Tagger(step, order, [f.name for f in out.fields], state, timeout_ms)
    return rows.groupBy(key_col).transformWithStateInPandas(tagger, out, "append", "ProcessingTime" if timeout_ms else "None")


class _RowTagger(_Tagger):
    """The same for a step over rows: a frame for every key costs more than the rows of most keys."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        state = self.held.get()
        epoch = timerValues.getCurrentProcessingTimeInMs() if self.timeout_ms else 0
        tagged, state = self.step(in_order(rows, self.order), None if state is None else tuple(state), epoch)
        self.held.update(state)
        made = Row(*self.columns)
        for values in tagged:
            yield made(*values)


def in_order(rows: Iterable[Row], order: Sequence[str]) -> list[Row]:
    """Rows by ``order``, NULL last; those that tie as they came."""
    return sorted(rows, key=lambda r: [(r[c] is None, r[c]) for c in order])


def fold_numbers(types: pd.Series, always_new: Sequence[str], clear_type: str | None, last_type, msg_no: int, epoch: int):
    """(epochs, message numbers, new state) of chunks in order; a clear chunk has no number."""
    cleared = (types == clear_type).to_numpy() if clear_type is not None else np.zeros(len(types), bool)
    section = np.cumsum(cleared)
    before = types.shift(1)
    before.iloc[0] = last_type
    fresh = np.append(msg_no < 0, cleared[:-1])  # nothing stands before it in its epoch
    same = (types == before) | (types.isna() & before.isna())
    starts = (types.isin(list(always_new)) | ~same).to_numpy() | fresh
    starts &= ~cleared
    base = np.where(section == 0, msg_no, -1)
    upto = np.cumsum(starts)
    number = base + upto - np.maximum.accumulate(np.where(cleared, upto, 0))
    last = len(types) - 1
    state = (None, -1) if cleared[last] else (types.iloc[last], int(number[last]))
    return epoch + section, np.where(cleared, -1, number), (*state, int(epoch + section[last]))


def fold_chunks_stream(
    chunks: DataFrame, always_new=("user",), clear_type: str | None = "clear", timeout_ms: int | None = None, *,
    key_col: str = "conv_id", order_cols: Sequence[str] = ("seq",), type_col: str = "type", text_col: str = "text",
) -> DataFrame:
    """Streaming chunks tagged with ``epoch`` and ``msg_no`` (append mode):
    ``key, *order, epoch, msg_no, type, text`` with the types of the input; a
    clear chunk has ``msg_no`` -1.

    ``timeout_ms`` is the time to live of a conversation's state.  An
    ``availableNow`` run with it needs ``state.without_empty_batches``.
    """
    order = list(order_cols)
    field = lambda c: T.StructField(c, chunks.schema[c].dataType)
    long = T.LongType()
    out = T.StructType([field(key_col), *map(field, order), T.StructField("epoch", long), T.StructField("msg_no", long),
                        field(type_col), field(text_col)])
    kept = T.StructType([T.StructField("last_type", chunks.schema[type_col].dataType), T.StructField("msg_no", long),
                         T.StructField("epoch", long)])

    def fold(pdf: pd.DataFrame, state: tuple | None, epoch: int):
        last_type, msg_no, epoch = state or (None, -1, epoch)
        epochs, numbers, new = fold_numbers(pdf[type_col], always_new, clear_type, last_type, msg_no, epoch)
        return pdf.assign(epoch=epochs, msg_no=numbers), new

    return _tagged(chunks, key_col, fold, order, out, kept, timeout_ms)


def last_epoch(tagged: DataFrame, key_col: str = "conv_id") -> DataFrame:
    """The chunks of each conversation's last epoch, without clear chunks."""
    newest = F.max("epoch").over(Window.partitionBy(key_col))
    return tagged.withColumn("_newest", newest).where("epoch = _newest AND msg_no >= 0").drop("_newest")


def tag_responses_stream(
    events: DataFrame, end_kinds=("end", "error_end"), timeout_ms: int | None = None, *,
    key_col: str = "key", order_cols: Sequence[str] = ("ts", "seq"), kind_col: str = "kind",
) -> DataFrame:
    """Each streaming event with its ``epoch`` and ``response_no`` (append
    mode): ``key, *order, kind, epoch, response_no``.  State per key is a
    counter and the epoch; the status of a response is an aggregate of its
    tagged rows downstream.  A key that returns after a timeout starts an epoch."""
    order = list(order_cols)
    field = lambda c: T.StructField(c, events.schema[c].dataType)
    long = T.LongType()
    out = T.StructType([field(key_col), *map(field, order), field(kind_col), T.StructField("epoch", long), T.StructField("response_no", long)])

    kept = T.StructType([T.StructField("done", long), T.StructField("epoch", long)])

    ends, columns = set(end_kinds), [f.name for f in out.fields[:-2]]

    def tag(rows: list[Row], state: tuple | None, epoch: int):
        done, epoch = state or (0, epoch)
        tagged = []
        for r in rows:  # response number = end markers seen before the row (a marker closes its own response)
            tagged.append((*(r[c] for c in columns), epoch, done))
            done += r[kind_col] in ends
        return tagged, (done, epoch)

    use_rocksdb(events.sparkSession)
    tagger = _RowTagger(tag, order, out.names, kept, timeout_ms)
    return events.groupBy(key_col).transformWithState(tagger, out, "append", "ProcessingTime" if timeout_ms else "None")
