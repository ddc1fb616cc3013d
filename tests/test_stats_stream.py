"""Statistics and imputed rows after every batch equal the batch forms; a replay changes nothing."""

import os

from pyspark.sql import functions as F
from revlens.operators.clean import impute_mean_by_group
from revlens.operators.stats import file_stats
from revlens.streaming import stats_stream as S

SCHEMA = "id long, file string, rating double, flag string, route string"
BATCHES = [
    [(1, "a", 4.0, "Verified", "x"), (2, "a", None, "No", "y"), (3, None, 2.0, "Verified", "x"), (4, "", None, None, None)],
    [(5, "a", 1.0, "Verified", "x"), (6, None, None, "No", "z"), (7, "null", 9.0, "Verified", "q")],
    [],
    [(8, "", 5.0, "Verified", "r"), (9, "b/c", None, "No", "s"), (9, "b/c", None, "No", "s")],
]
SPEC = dict(file_key="file", means=["rating"], category="route")


def take(spark, path, n):
    spec = SPEC | {"verified": F.col("flag") == "Verified"}
    S.update(spark, spark.createDataFrame(BATCHES[n], SCHEMA), n, path, **spec)


def check(spark, path, upto):
    seen = spark.createDataFrame([r for b in BATCHES[:upto] for r in b], SCHEMA)
    want = file_stats(seen, "file", "rating", "flag", "route")
    key = lambda r: tuple((x is not None, x) for x in r)
    got = S.current_stats(spark, path, "file", ["rating"])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    cols = ("id", "file", "rating", "flag", "route")
    filled = impute_mean_by_group(seen, ["file"], ["rating"])
    assert sorted((tuple(r) for r in S.current_rows(spark, path).select(*cols).collect()), key=key) == sorted((tuple(r) for r in filled.select(*cols).collect()), key=key)


def files_of(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(f"{path}/imputed") for f in fs if f.endswith(".parquet")}


def test_every_batch_equals_the_batch_form(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(len(BATCHES)):
        before = files_of(path)
        take(spark, path, n)
        check(spark, path, n + 1)
        untouched = {f for f in before if "_file==a" in f or "_file=%3Da" in f}
        if n == 3:  # no row of file a: its folder stays as it was
            assert untouched and untouched <= files_of(path)
    take(spark, path, 3)  # a replay
    check(spark, path, 4)


def test_batch_that_died_before_its_state(spark, tmp_path):
    path = str(tmp_path / "t")
    take(spark, path, 0)
    take(spark, path, 1)
    os.remove(f"{path}/state/1/_SUCCESS")
    assert S.current_stats(spark, path, "file", ["rating"]).agg(F.sum("n_reviews")).first()[0] == 4
    take(spark, path, 1)
    check(spark, path, 2)


def test_sketch_error(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(2):
        many = spark.range(n * 15000, n * 15000 + 20000).select(
            "id", F.lit("a").alias("file"), F.lit(1.0).alias("rating"), F.lit("No").alias("flag"), F.col("id").cast("string").alias("route"))
        S.update(spark, many, n, path, **(SPEC | {"verified": F.col("flag") == "Verified"}))
    (r,) = S.current_stats(spark, path, "file", ["rating"]).collect()
    assert r.n_reviews == 40000 and abs(r.n_categories - 35000) < 0.03 * 35000
