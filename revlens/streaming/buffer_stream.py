"""Buffered flush of a stream of chunks (T6): state, markers and timers.

A key's chunks gather in a buffer, which is flushed

* ``elapsed``: when a chunk arrives more than ``interval`` after the last flush (that chunk goes with it);
* ``end``: at an end marker, ``close``: when the connection closes, each if there is something to flush;
* ``timer``: when the oldest chunk in the buffer has waited for ``interval``, even if nothing arrives.

The clock is event time: a timer fires when the watermark has passed it, or when the key's next event
shows that it is due, whichever comes first, so that what is flushed, and when, does not depend on how
events are cut into micro-batches.  The last flush is taken to be the connection's first event until
there is one.  A close drops the key's state; a key that comes back opens anew, and ``opened_at`` tells
the two apart.  State is one row a key, and its text is what waits for the next flush.

Defined cases: an event that is older than what its key has seen takes the key's clock; one behind the
watermark is dropped by the engine; events without a time are left out; a NULL key is a key; a NULL or
empty chunk counts as a chunk and adds nothing; keys with markers alone flush nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from revlens.streaming.fold_stream import in_order
from revlens.streaming.state import use_rocksdb

STATE = "opened long, clock long, last long, number int, first long, n long, content string"
OUT = ["opened_at", "flush_no", "flushed_at", "reason", "n_chunks", "content"]
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


class Buffer:
    """One key's buffer; times are microseconds."""

    def __init__(self, state: tuple | None, interval: int, sep: str):
        self.interval, self.sep, self.out = interval, sep, []
        self.opened, self.clock, self.last, self.number, self.first, self.n, self.content = state or (None, None, None, 0, None, 0, "")

    @property
    def due(self) -> int | None:
        return self.first + self.interval if self.n else None

    def flush(self, at: int, reason: str) -> None:
        if self.n:
            self.out.append((self.opened, self.number, at, reason, self.n, self.content))
            self.number, self.last, self.first, self.n, self.content = self.number + 1, at, None, 0, ""

    def add(self, at: int, text: str | None) -> None:
        self.content = f"{self.content}{self.sep}{text or ''}" if self.n else text or ""
        self.first, self.n = self.first if self.n else at, self.n + 1
        if at - self.last > self.interval:
            self.flush(at, "elapsed")

    def event(self, at: int, kind: str, text: str | None, end_kinds, close_kind) -> None:
        if self.opened is None:
            self.opened = self.clock = self.last = at
        at = self.clock = max(at, self.clock)
        if self.n and self.due < at:
            self.flush(self.due, "timer")
        if kind == close_kind:
            self.flush(at, "close")
            self.opened, self.number = None, 0
        elif kind in end_kinds:
            self.flush(at, "end")
        else:
            self.add(at, text)

    def state(self) -> tuple:
        return self.opened, self.clock, self.last, self.number, self.first, self.n, self.content


class _Flusher(StatefulProcessor):
    def __init__(self, key_col: str, order: Sequence[str], kind_col: str, text_col: str, interval: int, end_kinds, close_kind, sep: str):
        self.key_col, self.order, self.kind_col, self.text_col = key_col, list(order), kind_col, text_col
        self.interval, self.end_kinds, self.close_kind, self.sep = interval, set(end_kinds), close_kind, sep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("buffer", STATE)

    def _open(self) -> Buffer:
        state = self.held.get()
        return Buffer(None if state is None else tuple(state), self.interval, self.sep)

    def _done(self, key, buffer: Buffer, due: int | None) -> Iterator[Row]:
        if buffer.opened is None:
            self.held.clear()
        else:
            self.held.update(buffer.state())
        now = buffer.due if buffer.opened is not None else None
        if due != now:
            if due is not None:
                self.handle.deleteTimer(-(-due // 1000))
            if now is not None:
                self.handle.registerTimer(-(-now // 1000))
        made = Row(self.key_col, *OUT)
        for opened, number, at, reason, n, content in buffer.out:
            yield made(key[0], EPOCH + timedelta(microseconds=opened), number, EPOCH + timedelta(microseconds=at), reason, n, content)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        buffer = self._open()
        due = buffer.due
        for r in in_order(rows, ["micros", *self.order]):
            buffer.event(r["micros"], r[self.kind_col], r[self.text_col], self.end_kinds, self.close_kind)
        yield from self._done(key, buffer, due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        buffer = self._open()
        if buffer.n and -(-buffer.due // 1000) <= expiredTimerInfo.getExpiryTimeInMs():
            buffer.clock = max(buffer.clock, buffer.due)
            buffer.flush(buffer.due, "timer")
            yield from self._done(key, buffer, None)

    def close(self) -> None:
        pass


def buffered_flush_stream(
    chunks: DataFrame, interval_seconds: float, end_kinds: Sequence[str] = ("end", "error_end"), close_kind: str = "close", *,
    key_col: str = "key", ts_col: str = "ts", order_cols: Sequence[str] = ("seq",), kind_col: str = "kind", text_col: str = "text",
    delay: str = "0 seconds", sep: str = "",
) -> DataFrame:
    """Flushes of a streaming frame of chunks (append mode): ``key, opened_at, flush_no, flushed_at, reason, n_chunks, content``."""
    use_rocksdb(chunks.sparkSession)
    field = T.StructField
    out = T.StructType([field(key_col, chunks.schema[key_col].dataType), field("opened_at", T.TimestampType()), field("flush_no", T.IntegerType()), field("flushed_at", T.TimestampType()),
                        field("reason", T.StringType()), field("n_chunks", T.LongType()), field("content", T.StringType())])
    events = chunks.where(F.col(ts_col).isNotNull()).withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, delay)
    events = events.select(key_col, ts_col, *order_cols, kind_col, text_col, F.unix_micros(ts_col).alias("micros"))
    flusher = _Flusher(key_col, order_cols, kind_col, text_col, round(interval_seconds * 1_000_000), end_kinds, close_kind, sep)
    return events.groupBy(key_col).transformWithState(flusher, out, "append", "EventTime")
