"""Buffered flush windows on a stream (T6): event-time tumbling windows per
key with a watermark, in update mode, merged into a table.

Each micro-batch emits the windows whose aggregate changed; ``foreachBatch``
upserts them by (key, window) into a table partitioned by day, rewriting only
the touched days.  The watermark lets the engine drop a window's state once
no more events can reach it, so state stays bounded by the watermark delay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from revlens.session import path_exists
from revlens.sources.index import upsert, write_partitioned


def windowed_concat(events: DataFrame, key_cols: Sequence[str], ts_col: str, text_col: str,
                    order_cols: Sequence[str], duration: str, delay: str, sep: str = "") -> DataFrame:
    """Streaming aggregate: count and ordered text per key and window.  The
    event time is used as ``timestamp`` (watermarks need it; a
    ``timestamp_ntz`` column is read in the session time zone)."""
    events = events.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    order = F.struct(*[F.col(c) for c in order_cols])
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(text_col).alias("t"))))
    return (
        events.withWatermark(ts_col, delay)
        .groupBy(*key_cols, F.window(ts_col, duration).alias("w"))
        .agg(F.count(F.lit(1)).alias("n_chunks"), pairs.alias("_pairs"))
        .select(*key_cols, F.col("w.start").alias("window_start"), "n_chunks",
                F.array_join(F.transform("_pairs", lambda x: x["t"]), sep).alias("content"))
    )


def start_flush_stream(
    spark: SparkSession, windows: DataFrame, key_cols: Sequence[str], path: str, checkpoint_path: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Merge updated windows into the table at ``path`` (latest aggregate wins)."""
    ids = [*key_cols, "window_start"]

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # used by several actions below; recomputable from the source
        try:
            _merge(batch)
        finally:
            batch.unpersist()

    def _merge(batch: DataFrame) -> None:
        if batch.isEmpty():
            return
        upd = batch.withColumn("day", F.to_date("window_start"))
        if path_exists(spark, path):
            touched = upd.select("day").distinct()
            base = spark.read.parquet(path).join(touched, "day", "left_semi").select(*upd.columns)
            merged = upsert(base, upd, ids)
            merged = merged.checkpoint(eager=True)  # it reads the files it will replace
        else:
            merged = upd
        write_partitioned(merged, path, ["day"])

    w = windows.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint_path)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
