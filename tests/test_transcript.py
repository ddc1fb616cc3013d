"""Transcript folding, response status, clear, flush (T2-T6, A7, F8, F9), batch and stream."""

import pytest
from pyspark.sql import functions as F

from revlens.operators.transcript import (
    after_last, drop_after_first, fold_runs, non_empty, ordered_concat, response_status, tumbling_concat,
)
from revlens.session import scratch_path
from revlens.streaming.fold_stream import fold_chunks_stream, last_epoch

# conv, seq, kind, text  (kinds: user, chunk, end, error_end, clear)
STREAM = [
    (1, 1, "user", "hi"), (1, 2, "chunk", "a"), (1, 3, "chunk", "b"), (1, 4, "end", ""),
    (1, 5, "chunk", "c"), (1, 6, "end", ""),                   # second response, no user row between
    (1, 7, "user", "q2"), (1, 8, "user", "q3"),                 # two user rows in a row
    (1, 9, "chunk", ""), (1, 10, "chunk", "  "),                # empty chunk dropped, blanks kept
    (2, 1, "user", "x"), (2, 2, "chunk", "p"), (2, 3, "chunk", "Sorry."), (2, 4, "error_end", ""),
    (2, 5, "chunk", "late"),                                    # after the error end: dropped
    (3, 1, "user", "old"), (3, 2, "chunk", "o"), (3, 3, "clear", ""), (3, 4, "user", "new"),
    (3, 5, "chunk", "n"),                                       # no end yet: open
]


def _df(spark):
    return spark.createDataFrame(STREAM, "conv_id long, seq long, kind string, text string")


def _messages(df, strategy):
    msg = df.where(F.col("kind").isin("user", "chunk")).withColumn(
        "type", F.when(F.col("kind") == "user", "user").otherwise("ai"))
    msg = non_empty(msg, "text")
    out = fold_runs(msg, ["conv_id"], ["seq"], "type", [ordered_concat("text", ["seq"]).alias("content")],
                    always_new=["user"], strategy=strategy)
    return sorted((r.conv_id, r.msg_no, r.type, r.content) for r in out.collect())


@pytest.mark.parametrize("strategy", ["ranged", "window"])
def test_fold(spark, strategy):
    df = _df(spark)
    df = after_last(df, ["conv_id"], ["seq"], F.col("kind") == "clear")
    df = drop_after_first(df, ["conv_id"], ["seq"], F.col("kind") == "error_end")
    assert _messages(df, strategy) == [
        (1, 0, "user", "hi"), (1, 1, "ai", "abc"), (1, 2, "user", "q2"), (1, 3, "user", "q3"), (1, 4, "ai", "  "),
        (2, 0, "user", "x"), (2, 1, "ai", "pSorry."),
        (3, 0, "user", "new"), (3, 1, "ai", "n"),
    ]


@pytest.mark.parametrize("strategy", ["ranged", "window"])
def test_status(spark, strategy):
    df = drop_after_first(_df(spark), ["conv_id"], ["seq"], F.col("kind") == "error_end")
    st = response_status(df, ["conv_id"], ["seq"], "kind", "end", "error_end", strategy=strategy)
    got = sorted((r.conv_id, r.response_no, r.status) for r in st.collect())
    assert got == [(1, 0, "complete"), (1, 1, "complete"), (1, 2, "open"), (2, 0, "error"), (3, 0, "open")]


def test_tumbling_concat(spark):
    df = spark.createDataFrame(
        [(1, "2024-01-01 00:00:10", "a", 1), (1, "2024-01-01 00:00:50", "b", 2), (1, "2024-01-01 00:01:05", "c", 3)],
        "conv_id long, ts string, text string, seq long").withColumn("ts", F.to_timestamp("ts"))
    out = sorted((r.n_chunks, r.content) for r in tumbling_concat(df, ["conv_id"], "ts", "text", ["seq"],
                                                                  "1 minute").collect())
    assert out == [(1, "c"), (2, "ab")]


def test_stream_fold_equals_batch(spark):
    rows = [(c, s, "user" if k == "user" else "ai", t) for c, s, k, t in STREAM
            if k in ("user", "chunk") and t != "" and c == 1]
    rows += [(9, 1, "ai", "old"), (9, 2, "clear", ""), (9, 7, "ai", "new"), (9, 8, None, "?"), (9, 9, None, "!"),
             (8, 1, "ai", "gone"), (8, 9, "clear", "")]
    df = spark.createDataFrame(rows, "conv_id long, seq long, type string, text string")
    src = scratch_path(spark, "t-chunks")
    df.where("seq <= 5").coalesce(1).write.parquet(src)
    df.where("seq > 5").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    sink = scratch_path(spark, "t-folded")
    q = (fold_chunks_stream(stream).writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", scratch_path(spark, "t-folded-ck")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = last_epoch(spark.read.parquet(sink)).groupBy("conv_id", "msg_no").agg(
        F.first("type").alias("type"), ordered_concat("text", ["seq"]).alias("content"))
    assert sorted((r.conv_id, r.msg_no, r.type, r.content) for r in got.collect()) == [
        (1, 0, "user", "hi"), (1, 1, "ai", "abc"), (1, 2, "user", "q2"), (1, 3, "user", "q3"), (1, 4, "ai", "  "),
        (9, 0, "ai", "new"), (9, 1, None, "?!")]


def test_stream_status_equals_batch(spark):
    from revlens.streaming.fold_stream import tag_responses_stream

    rows = [(c, s, k) for c, s, k, _ in STREAM if c in (1, 2)]
    df = spark.createDataFrame(rows, "key long, seq long, kind string").withColumn(
        "ts", F.timestamp_seconds(F.col("seq")))
    src = scratch_path(spark, "t-events")
    df.where("seq <= 4").coalesce(1).write.parquet(src)
    df.where("seq > 4").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    sink = scratch_path(spark, "t-tagged")
    q = (tag_responses_stream(stream).writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", scratch_path(spark, "t-tagged-ck")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = sorted((r.key, r.seq, r.response_no) for r in spark.read.parquet(sink).collect())
    want = {(1, s): n for s, n in [(1, 0), (2, 0), (3, 0), (4, 0), (5, 1), (6, 1), (7, 2), (8, 2), (9, 2), (10, 2)]}
    want.update({(2, s): 0 for s in (1, 2, 3, 4)})
    want[(2, 5)] = 1
    assert got == sorted((k, s, n) for (k, s), n in want.items())


def test_flush_stream_equals_batch(spark):
    from revlens.streaming.flush_stream import start_flush_stream, windowed_concat

    rows = [(1, "2024-01-01 00:00:10", "a", 1), (1, "2024-01-01 00:00:50", "b", 2), (1, "2024-01-01 00:01:05", "c", 3),
            (2, "2024-01-01 00:00:30", "x", 4), (1, "2024-01-01 00:00:55", "d", 5), (1, "2024-01-01 00:03:00", "e", 6)]
    df = spark.createDataFrame(rows, "conv_id long, ts string, text string, seq long").withColumn(
        "ts", F.to_timestamp("ts"))
    src = scratch_path(spark, "t-flush-src")
    df.where("seq <= 3").coalesce(1).write.parquet(src)
    df.where("seq > 3").coalesce(1).write.mode("append").parquet(src)  # later batch updates an open window
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    windows = windowed_concat(stream, ["conv_id"], "ts", "text", ["ts", "seq"], "1 minute", "5 minutes")
    path = scratch_path(spark, "t-flush")
    q = start_flush_stream(spark, windows, ["conv_id"], path, scratch_path(spark, "t-flush-ck"))
    q.awaitTermination(120)
    got = sorted((r.conv_id, r.n_chunks, r.content) for r in spark.read.parquet(path).collect())
    batch = tumbling_concat(df, ["conv_id"], "ts", "text", ["ts", "seq"], "1 minute")
    assert got == sorted((r.conv_id, r.n_chunks, r.content) for r in batch.collect())
    assert (1, 3, "abd") in got
