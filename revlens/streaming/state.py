"""What queries with arbitrary state need of the session."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State of any size lives in RocksDB on the executors and, as changes, in the checkpoint folder;
    ``transformWithState`` takes no other provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def without_empty_batches(spark: SparkSession) -> None:
    """For ``availableNow`` runs of queries that look at the processing clock: these would ask for one more
    batch for ever, to see what has expired meanwhile."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
