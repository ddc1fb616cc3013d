"""File statistics (A1-A5) and mean imputation (C7) kept up to date on a stream.

Each micro-batch is reduced to one partial state a file (row count, sum and count of every averaged
column, verified rows, a HyperLogLog sketch of the distinct categories), which is merged with the
state of the batch before and written as a table of its own: no earlier row is read for statistics,
whatever the stream has seen.  Rows land by batch and file; only files that got rows in a batch are
imputed again, with means taken from the state, and only their partitions are replaced.

A replayed batch overwrites what it wrote: its rows, its state (merged from the state before it) and
the same partitions.  A write that dies leaves the last state with a ``_SUCCESS`` file as the current
one.  States older than the one before the last batch are deleted.

Defined cases: rows with a NULL file are a file of their own, apart from the empty name; a NULL
category or value is not counted; a file whose values are all NULL has a NULL mean and keeps NULL; an
empty batch changes nothing.  Columns ``_file``, ``_batch`` and ``_mean_*`` are taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from revlens.session import path_exists

SKETCH_BITS = 14  # some 1 % of error; distinct counts of a few hundred are exact


def _file_name(file_key: str) -> Column:
    """A folder name that tells NULL from every text."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{file_key}`").cast("string")), F.lit("null"))


def _partial(batch: DataFrame, means: Sequence[str], verified: Column, category: str) -> DataFrame:
    """One state a file; sketches and sums combine before the shuffle."""
    sums = [x for i, c in enumerate(means) for x in (
        F.sum(F.col(f"`{c}`").cast("double")).alias(f"sum_{i}"), F.count(F.col(f"`{c}`")).alias(f"count_{i}"))]
    return batch.groupBy("_file").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(verified).alias("n_verified"), *sums,
        F.hll_sketch_agg(F.col(f"`{category}`").cast("string"), F.lit(SKETCH_BITS)).alias("sketch"), F.lit(True).alias("touched"))


def _merged(states: DataFrame, n_means: int) -> DataFrame:
    sums = [x for i in range(n_means) for x in (F.sum(f"sum_{i}").alias(f"sum_{i}"), F.sum(f"count_{i}").alias(f"count_{i}"))]
    return states.groupBy("_file").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_verified").alias("n_verified"), *sums,
        F.hll_union_agg("sketch").alias("sketch"), F.max("touched").alias("touched"))


def _states(spark: SparkSession, path: str) -> list[int]:
    """Batches with a complete state, ascending (a folder of three entries at most)."""
    folder = f"{path}/state"
    if not path_exists(spark, folder):
        return []
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n) for n in names if n.isdigit() and path_exists(spark, f"{folder}/{n}/_SUCCESS"))


def _forget(spark: SparkSession, path: str, before: int) -> None:
    for b in _states(spark, path):
        if b < before:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/state/{b}")
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def update(spark: SparkSession, batch: DataFrame, batch_id: int, path: str, *, file_key: str, means: Sequence[str],
           verified: Column, category: str) -> None:
    """Take one micro-batch into the tables under ``path``."""
    batch = batch.withColumn("_file", _file_name(file_key)).persist()  # read by the emptiness check and two writes
    try:
        if batch.isEmpty():
            return
        dynamic = {"partitionOverwriteMode": "dynamic"}
        batch.withColumn("_batch", F.lit(batch_id)).write.partitionBy("_batch", "_file").options(**dynamic).mode("overwrite").parquet(f"{path}/rows")
        state = _partial(batch, means, verified, category)
        before = [b for b in _states(spark, path) if b < batch_id]
        if before:
            old = spark.read.parquet(f"{path}/state/{before[-1]}").withColumn("touched", F.lit(False))
            state = _merged(old.unionByName(state), len(means))
        state.write.mode("overwrite").parquet(f"{path}/state/{batch_id}")
        # statistics of this batch's files alone; the join leaves out all other files' folders
        now = spark.read.parquet(f"{path}/state/{batch_id}").where("touched").select(
            "_file", *(F.try_divide(f"sum_{i}", f"count_{i}").alias(f"_mean_{i}") for i in range(len(means))))
        rows = spark.read.parquet(f"{path}/rows").where(F.col("_batch") <= batch_id).drop("_batch")
        filled = [F.coalesce(F.col(f"`{c}`").cast("double"), F.col(f"_mean_{means.index(c)}")).alias(c) if c in means else F.col(f"`{c}`")
                  for c in rows.columns]
        rows.join(now, "_file").select(*filled).write.partitionBy("_file").options(**dynamic).mode("overwrite").parquet(f"{path}/imputed")
        _forget(spark, path, before[-1] if before else batch_id)
    finally:
        batch.unpersist()


def start_stats_stream(
    spark: SparkSession, rows: DataFrame, path: str, checkpoint_path: str, *, file_key: str, means: Sequence[str],
    verified: Column, category: str, available_now: bool = True,
) -> StreamingQuery:
    """Keep statistics and imputed rows of ``rows`` under ``path`` (read by ``current_stats``, ``current_rows``)."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        update(spark, batch, batch_id, path, file_key=file_key, means=means, verified=verified, category=category)

    w = rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint_path)
    return (w.trigger(availableNow=True) if available_now else w).start()


def current_stats(spark: SparkSession, path: str, file_key: str, means: Sequence[str]) -> DataFrame:
    """``file_key, n_reviews, avg_<column>..., n_verified, n_categories`` as of the last batch."""
    state = spark.read.parquet(f"{path}/state/{_states(spark, path)[-1]}")
    return state.select(
        F.when(F.col("_file") != "null", F.substring("_file", 2, 1 << 30)).alias(file_key), F.col("n_rows").alias("n_reviews"),
        *(F.try_divide(f"sum_{i}", f"count_{i}").alias(f"avg_{c}") for i, c in enumerate(means)),
        "n_verified", F.hll_sketch_estimate("sketch").alias("n_categories"))


def current_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows, NULL values of the averaged columns replaced by their file's mean."""
    return spark.read.parquet(f"{path}/imputed").drop("_file")
