"""Long -> wide with "last value wins" per name (H4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot_last(
    df: DataFrame, key_cols: Sequence[str], name_col: str, value_col: str, order_cols: Sequence[str],
    names: Sequence[str],
) -> DataFrame:
    """One row per key, one column per name in ``names`` holding the value of
    the last row (by ``order_cols``) with that name; absent names are NULL.

    The fixed name list avoids the extra pass that discovers pivot values, and
    each cell is a ``max_by`` partial aggregate, so a hot key is combined on
    the map side.
    """
    order = F.struct(*[F.col(c) for c in order_cols])
    return (
        df.groupBy(*key_cols)
        .pivot(name_col, list(names))
        .agg(F.max_by(F.col(value_col), order))
    )
