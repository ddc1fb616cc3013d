"""Index upsert from a stream of documents (S10 / E5 in streaming form).

Each micro-batch is merged into the vector table with the batch upsert
(latest-wins per id, only the touched entity partitions rewritten).  Replaying
a batch after a failure applies the same rows again, which leaves the table
unchanged (the upsert is idempotent).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from revlens.operators.embed import DEFAULT_DIM
from revlens.plans.build_index import build_index


def start_index_stream(
    spark: SparkSession, docs: DataFrame, path: str, checkpoint_path: str, *, id_col: str, text_col: str,
    entity_col: str, meta_cols: Sequence[str] = (), dim: int = DEFAULT_DIM, available_now: bool = True,
    buckets: int | None = None,
) -> StreamingQuery:
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read by the emptiness check and the merge
        try:
            if batch.isEmpty():  # e.g. an empty source file: nothing to merge
                return
            build_index(spark, batch, path, id_col=id_col, text_col=text_col, entity_col=entity_col,
                        meta_cols=meta_cols, dim=dim, buckets=buckets)
        finally:
            batch.unpersist()

    w = docs.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint_path)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
