"""Scaling probe on inputs derived from the given tables (not a registered query).

(a) filtered top-k as the corpus grows: the embeddings table replicated r
    times (new ids, same vectors) with ``explode(sequence(1, r))``;
(b) transcript folding with one user holding a third of all rows: the events
    table replicated r times, ranged vs window form.

Prints one JSON line per measurement.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402


def _time(build) -> float:
    """Seconds to build the plan (eager checkpoints, size checks) and run it."""
    t = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - t, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    from revlens.operators.retrieve import group_centroids, topk_cosine
    from revlens.operators.transcript import fold_runs
    from revlens.session import get_session, load_table

    spark = get_session("local[8]", shuffle_partitions=16)
    emb = load_table(spark, sf_dir, "embeddings")
    for r in (1, 10, 50, 100):
        corpus = emb.select(F.explode(F.sequence(F.lit(0), F.lit(r - 1))).alias("rep"), "*").select(
            (F.col("vec_id") * 1000 + F.col("rep")).alias("vec_id"), "embedding", "label")
        corpus = corpus.repartition(max(8, r // 4)).checkpoint()
        q = group_centroids(emb, "label", "embedding", "query_vector").select(
            F.col("label").alias("query_id"), "query_vector", F.col("label").alias("filter_entity"))
        n = corpus.count()
        for strategy in ("blocked", "expr"):
            sec = _time(lambda: topk_cosine(corpus, q, 5, id_col="vec_id", vec_col="embedding",  # noqa: B023
                                            entity_col="label", dim=64, strategy=strategy))  # noqa: B023
            print(json.dumps({"probe": "filtered_topk", "corpus_rows": n, "strategy": strategy, "sec": sec}),
                  flush=True)

    ev = load_table(spark, sf_dir, "events")
    for r in (1, 10, 30):
        big = ev.select(F.explode(F.sequence(F.lit(0), F.lit(r - 1))).alias("rep"), "*").select(
            (F.col("event_id") * 100 + F.col("rep")).alias("event_id"),
            (F.col("ts") + F.make_interval(days=F.col("rep") * 400)).alias("ts"),
            F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id")).alias("user_id"),
            "event_type", "value")
        big = big.repartition(max(8, r)).checkpoint()
        n = big.count()
        for strategy in ("window", "ranged"):
            sec = _time(lambda: fold_runs(big, ["user_id"], ["ts", "event_id"], "event_type",  # noqa: B023
                                          [F.count(F.lit(1)).alias("n")], ["signup"], strategy=strategy))  # noqa: B023
            print(json.dumps({"probe": "fold_runs_hot_user_third", "rows": n, "strategy": strategy, "sec": sec}),
                  flush=True)


if __name__ == "__main__":
    main()
