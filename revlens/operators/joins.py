"""Join and split helpers.

Sides of joins carry no broadcast hints: the planner and AQE decide from
measured bytes, and no job runs while a plan is being built.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition of an input with fewer splits than the cluster's
    parallelism (e.g. a large file stored as one row group) ahead of CPU-heavy
    per-row work.  A frame that comes out of a shuffle is left as it is: asking
    for its partition count would run the stages below it."""
    n = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def with_group(df: DataFrame, groups: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """``df`` and the columns that ``groups`` has for its key (NULL where it has none).  A NULL key is a
    value of its own, as it is in a ``groupBy``."""
    renamed = groups.withColumnsRenamed({c: f"_of{i}" for i, c in enumerate(key_cols)})
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_of{i}")) for i, c in enumerate(key_cols)))
    return df.join(renamed, same, "left").drop(*(f"_of{i}" for i in range(len(key_cols))))
