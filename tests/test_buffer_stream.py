"""Buffered flush with markers, close and timers (T6), and state that expires."""

import time
from datetime import datetime, timedelta

from revlens.session import scratch_path
from revlens.streaming.buffer_stream import Buffer, buffered_flush_stream
from revlens.streaming.fold_stream import fold_chunks_stream
from revlens.streaming.state import without_empty_batches

T0 = datetime(2024, 1, 1)
SCHEMA = "key long, ts timestamp, seq int, kind string, text string"


def _run(spark, batches, make, name, sink=None, ckpt=None, src=None):
    src, sink, ckpt = src or scratch_path(spark, f"{name}-src"), sink or scratch_path(spark, name), ckpt or scratch_path(spark, f"{name}-ckpt")
    schema = None
    for rows, schema in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = make(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(sink), (src, sink, ckpt)


def test_buffer_rules():
    b = Buffer(None, 10, "")
    for at, kind, text in [(0, "chunk", "a"), (5, "chunk", "b"), (11, "chunk", "c"), (12, "chunk", None), (13, "end", None), (13, "end", None), (14, "chunk", "d"), (40, "chunk", "e"), (39, "chunk", "late"), (60, "close", None)]:
        b.event(at, kind, text, {"end"}, "close")
    # "a" waited from 0 to 10; then c is within 10 of that flush; e comes more than 10 after the last flush
    assert b.out == [(0, 0, 10, "timer", 2, "ab"), (0, 1, 13, "end", 2, "c"), (0, 2, 24, "timer", 1, "d"), (0, 3, 40, "elapsed", 1, "e"), (0, 4, 50, "timer", 1, "late")]
    assert b.opened is None  # closed
    only = Buffer(None, 10, "")
    for kind in ("end", "end", "close"):
        only.event(1, kind, None, {"end"}, "close")
    assert only.out == []
    gap = Buffer(None, 10, "")
    gap.event(0, "end", None, {"end"}, "close")
    gap.event(30, "chunk", "x", {"end"}, "close")
    assert gap.out == [(0, 0, 30, "elapsed", 1, "x")]


def test_timers_late_null_and_closed_keys(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    one = [(1, at(0), 1, "chunk", "a"), (1, at(4), 2, "chunk", "b"), (None, at(1), 1, "chunk", "n"), (2, at(2), 1, "end", None), (3, None, 1, "chunk", "no time")]
    two = [(2, at(50), 2, "chunk", "x"), (2, at(51), 3, "close", None)]  # moves the watermark: 1 and the NULL key are due
    three = [(1, at(3), 3, "chunk", "behind the watermark"), (2, at(60), 4, "chunk", "back"), (2, at(61), 5, "end", None), (4, at(62), 1, "chunk", "waits")]
    out, _ = _run(spark, [(r, SCHEMA) for r in (one, two, three)], lambda s: buffered_flush_stream(s, 10), "buffer")
    got = sorted((str(r.key), r.opened_at, r.flush_no, r.flushed_at, r.reason, r.n_chunks, r.content) for r in out.collect())
    assert got == [
        ("1", at(0), 0, at(10), "timer", 2, "ab"), ("2", at(2), 0, at(50), "elapsed", 1, "x"),
        ("2", at(60), 0, at(61), "end", 1, "back"), ("None", at(1), 0, at(11), "timer", 1, "n")]


CHUNKS = "conv_id long, seq int, type string, text string"


def test_state_lives_on_after_a_restart_and_expires(spark):
    first, second = [(1, 1, "user", "q"), (1, 2, "ai", "a")], [(1, 3, "ai", "b"), (1, 4, "user", "c")]
    without_empty_batches(spark)
    try:
        for ttl, same in ((None, True), (3_600_000, True), (500, False)):
            fold = lambda s, ttl=ttl: fold_chunks_stream(s, timeout_ms=ttl)
            _, (src, sink, ckpt) = _run(spark, [(first, CHUNKS)], fold, "ttl")
            time.sleep(1.5)
            out, _ = _run(spark, [(second, CHUNKS)], fold, "ttl", sink, ckpt, src)
            got = {r.seq: (r.epoch, r.msg_no) for r in out.collect()}
            assert len(got) == out.count() == 4  # no row lost or repeated by the restart
            if same:
                assert [got[s][1] for s in (1, 2, 3, 4)] == [0, 1, 1, 2] and len({e for e, _ in got.values()}) == 1
            else:  # a new epoch, later than the first one
                assert [got[s][1] for s in (1, 2, 3, 4)] == [0, 1, 0, 1] and got[3][0] > got[1][0]
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
