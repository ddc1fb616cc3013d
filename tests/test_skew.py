"""Hot-key behaviour: one user holds a third of all events (derived from the
given events table).  The ranged forms must equal the window forms, and the
range partitioning must split the hot user across tasks."""

from pyspark.sql import functions as F

from revlens.operators.transcript import fold_runs, response_status

SF = "/root/testdata/sf0.01"


def _skewed(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    return e.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id")))


def test_hot_key_is_split_by_ranges(spark):
    e = _skewed(spark)
    n = e.count()
    assert e.where("user_id = -1").count() * 3 >= n - 3
    sizes = (e.repartitionByRange(8, "user_id", "ts", "event_id").groupBy(F.spark_partition_id().alias("p"))
             .count().collect())
    assert max(r["count"] for r in sizes) < 0.2 * n  # the hot third is spread over several ranges


def test_ranged_equals_window_under_skew(spark):
    e = _skewed(spark)
    aggs = [F.count(F.lit(1)).alias("n")]
    a = fold_runs(e, ["user_id"], ["ts", "event_id"], "event_type", aggs, ["signup"], strategy="ranged")
    b = fold_runs(e, ["user_id"], ["ts", "event_id"], "event_type", aggs, ["signup"], strategy="window")
    cols = ["user_id", "msg_no", "event_type", "n"]
    assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))
    s1 = response_status(e, ["user_id"], ["ts", "event_id"], "event_type", "purchase", "error", strategy="ranged")
    s2 = response_status(e, ["user_id"], ["ts", "event_id"], "event_type", "purchase", "error", strategy="window")
    cols = ["user_id", "response_no", "status", "n_chunks"]
    assert sorted(map(tuple, s1.select(cols).collect())) == sorted(map(tuple, s2.select(cols).collect()))
