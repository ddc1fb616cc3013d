"""Per-file statistics and union."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_stats(
    df: DataFrame,
    file_key: str,
    rating: str,
    verification: str,
    route: str,
    verified_value: str = "Verified",
    with_total: bool = False,
    exact_distinct: bool = True,
) -> DataFrame:
    """One row per file: review count, mean rating, verified count, distinct
    routes (after the category default, so "Not specified" counts as a route).

    ``with_total`` adds the all-files row via ``rollup`` in the same job and a
    column ``is_total``, which tells it from a file whose key is NULL.  All aggregates combine partially on the map side;
    ``exact_distinct=False`` switches the route count to HyperLogLog++ for very
    large files.
    """
    distinct = (
        F.countDistinct(F.col(f"`{route}`")) if exact_distinct else F.approx_count_distinct(F.col(f"`{route}`"))
    )
    aggs = [
        F.count(F.lit(1)).alias("n_reviews"),
        F.avg(F.col(f"`{rating}`")).alias("avg_rating"),
        F.count_if(F.col(f"`{verification}`") == F.lit(verified_value)).alias("n_verified"),
        distinct.alias("n_routes"),
    ]
    if not with_total:
        return df.groupBy(file_key).agg(*aggs)
    return df.rollup(file_key).agg((F.grouping(file_key) == 1).alias("is_total"), *aggs)


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Union all, columns aligned by name, a missing column becomes NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
