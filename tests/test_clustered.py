"""Clustered index (R6): exact form equals brute force, lists are left out where vectors are clustered."""

import numpy as np
from pyspark.sql import functions as F

from revlens.operators import clustered
from revlens.operators.retrieve import topk_cosine
from revlens.session import scratch_path

SCHEMA = "id long, vector array<double>, entity string"


def _rows(n=600, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8)) * 4
    rows = [(i, (centres[i % 12] + rng.normal(size=8) * 0.3).tolist(), "ab"[i % 7 == 0]) for i in range(n)]
    rows += [(n + i, rows[0][1], rows[0][2]) for i in range(200)]  # one vector many times
    return rows + [(9000, None, "a"), (9001, [1.0], "a"), (9002, [float("nan")] * 8, "a"), (9003, [0.0] * 8, "b"), (9004, rows[1][1], None)]


def _triples(df):
    return sorted((r[0], r[1], r[2], round(r[3], 9)) for r in df.collect())


def test_exact_is_brute_force_and_default_finds_nine_in_ten(spark):
    rows = spark.createDataFrame(_rows(), SCHEMA).repartition(4)
    q = rows.where("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"), F.col("entity").alias("filter_entity"))
    index = clustered.build(rows, scratch_path(spark, "t-clusters"), dim=8, key_cols=["entity"], n_lists=12)
    assert index.rows(spark).count() == 801  # all but the four that have no score
    want = _triples(topk_cosine(rows, q, 5, dim=8))
    assert _triples(clustered.search(index, q, 5, exact=True, q_key_cols=["filter_entity"])) == want
    near = _triples(clustered.search(index, q, 5, q_key_cols=["filter_entity"]))
    hit = {(a, c) for a, _, c, _ in near}
    assert len([1 for a, _, c, _ in want if (a, c) in hit]) >= 0.9 * len(want)


def test_lists_beyond_the_bound_are_not_visited(spark):
    rows = spark.createDataFrame(_rows(), SCHEMA).where("entity IS NOT NULL")
    q = rows.where("id < 60").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    index = clustered.build(rows, scratch_path(spark, "t-clusters"), dim=8, n_lists=12)
    assert clustered.visited(index, q, 3, exact=True) < 0.5
    got = clustered.search(index, q, 3, exact=True)
    assert got.columns == ["query_id", "rank", "id", "score"] and got.count() == 180


def test_empty_index_and_questions(spark):
    rows = spark.createDataFrame(_rows(), SCHEMA)
    q = rows.where("id < 3").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    empty = clustered.build(rows.where("id < 0"), scratch_path(spark, "t-clusters"), dim=8)
    assert clustered.search(empty, q, 3).count() == 0
    index = clustered.build(rows, scratch_path(spark, "t-clusters"), dim=8, n_lists=4)
    assert clustered.search(index, q.where("query_id < 0"), 3).count() == 0
