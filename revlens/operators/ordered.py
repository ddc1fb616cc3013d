"""Order-dependent operators without a global single-partition window.

``with_row_index`` numbers rows 0..n-1 in a total order (C10, E1):

1. range-partition on the order columns (a hot key is split over several
   ranges because the order columns are unique) and sort within partitions;
2. position inside the partition = ``monotonically_increasing_id`` minus the
   partition's id base;
3. rows per partition -> prefix sum over that tiny table (one row per
   partition, so its size is bounded by the partition count) -> broadcast join.

Only the order columns need to be unique; callers add a tie-break column.
``with_running_count`` numbers runs and markers within keys in the same manner.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.session import ensure_checkpoint_dir


def _n_partitions(df: DataFrame, n: int | None) -> int:
    """Range count: the shuffle partitions, which are sized with the data (the
    count table that is prefix-summed has one row per range)."""
    return n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_row_index(
    df: DataFrame, order_cols: Sequence[str], out_col: str = "row_id", num_partitions: int | None = None,
    checkpoint: bool = True,
) -> DataFrame:
    """Add ``out_col`` = 0-based position of the row in ``order_cols`` order.

    The ranged, position-tagged rows are written with a reliable
    ``checkpoint()`` (to the folder named by ``spark.checkpoint.dir``) before
    they are counted and numbered.  Both steps then read the same partitions:
    without it, an input coming out of a shuffle (row order inside a partition
    not fixed) could be range-sampled differently by the two branches, and a
    lost executor could re-create a partition with other positions.
    ``checkpoint=False`` is only safe for inputs read straight from files.
    """
    n = _n_partitions(df, num_partitions)
    ranged = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    tagged = ranged.withColumn("_pid", F.spark_partition_id()).withColumn(
        "_pos", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)
    )
    if checkpoint:
        ensure_checkpoint_dir(df.sparkSession)
        tagged = tagged.checkpoint(eager=True)
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_off"),
    )
    # ``offsets`` has one row per partition: its size is bounded by ``n``.
    return tagged.join(F.broadcast(offsets), "_pid").select(
        *df.columns, (F.col("_off") + F.col("_pos")).alias(out_col)
    )


def with_group_row_number(
    df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], out_col: str = "row_no",
    num_partitions: int | None = None,
) -> DataFrame:
    """0-based row number within each group (e.g. ``reset_index`` per file).

    Global index in (group, order) order minus the group's first index; the
    per-group minimum is a partial aggregate, so a hot group is not gathered.
    A NULL group key is a group of its own, as in ``groupBy``.
    """
    idx = with_row_index(df, [*group_cols, *order_cols], "_gidx", num_partitions)
    first = idx.groupBy(*group_cols).agg(F.min("_gidx").alias("_first"))
    first = first.select(*[F.col(f"`{c}`").alias(f"_g{i}") for i, c in enumerate(group_cols)], "_first")
    same = reduce(and_, (F.col(f"`{c}`").eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group_cols)))
    return idx.join(first, same).select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col("_gidx") - F.col("_first")).alias(out_col)
    )


def _fingerprint(cols: Sequence[str]) -> tuple[Column, Column]:
    """96 bits that are equal where all columns are (NULL is a value)."""
    parts = [x for c in cols for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return F.xxhash64(*parts), F.hash(*parts)


def with_running_count(
    df: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str], flag: Column, change_col: str | None = None,
    out_col: str = "running", num_partitions: int | None = None,
) -> DataFrame:
    """Add ``out_col`` = how many of the key's rows up to and including this one
    start something: rows where ``flag`` holds and, with ``change_col``, rows
    whose value differs from the row before (the key's first row included).

    One range partitioning on (key, order), so that a hot key is spread over
    many ranges; each range counts its rows in one pass over Arrow batches, is
    written with a reliable ``checkpoint()``, and a table of one row per range
    (its first and last row) carries counts into the next ranges.  NULL keys
    and NULL values are values of their own.  The order must be unique in a key.
    """
    ensure_checkpoint_dir(df.sparkSession)
    n = _n_partitions(df, num_partitions)
    k1, k2 = _fingerprint(key_cols)
    c1 = _fingerprint([change_col])[0] if change_col else F.lit(0).cast("bigint")
    marks = df.select(
        *[F.col(f"`{c}`") for c in df.columns], k1.alias("_k1"), k2.alias("_k2"), c1.alias("_c"),
        F.coalesce(flag, F.lit(False)).alias("_f"))
    ranged = marks.repartitionByRange(n, *key_cols, *order_cols).sortWithinPartitions(*key_cols, *order_cols)
    changes = change_col is not None
    long, added = T.LongType(), ("_pid", "_pos", "_n", "_head")
    schema = T.StructType([*ranged.schema.fields, T.StructField("_pid", long), T.StructField("_pos", long),
                           T.StructField("_n", long), T.StructField("_head", T.BooleanType())])

    def count(batches):
        pid, before, held, at, head = TaskContext.get().partitionId(), None, 0, 0, True
        for b in batches:
            if not b.num_rows:
                continue
            a, h, c, f = (b.column(b.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in ("_k1", "_k2", "_c", "_f"))
            new_key, change = np.zeros(len(a), bool), np.ones(len(a), bool)
            new_key[1:] = (a[1:] != a[:-1]) | (h[1:] != h[:-1])
            change[1:] = c[1:] != c[:-1]
            if before is not None:
                new_key[0] = (a[0], h[0]) != before[:2]
                change[0] = c[0] != before[2]
            start = f | (changes & (change | new_key))
            total = np.cumsum(start)
            own = np.maximum.accumulate(np.where(new_key, np.arange(len(a)), -1))  # where the row's key began
            number = total - np.where(own >= 0, total[own] - start[own], -held)
            first_key = head & (own < 0)
            extra = [np.full(len(a), pid), at + np.arange(len(a)), number, first_key]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, extra)], [*b.schema.names, *added])
            before, held, at, head = (a[-1], h[-1], c[-1]), int(number[-1]), at + len(a), bool(first_key[-1])

    tagged = ranged.mapInArrow(count, schema).checkpoint(eager=True)
    edge = F.struct("_k1", "_k2", "_c", "_f", "_n", "_head")
    edges = tagged.groupBy("_pid").agg(F.min_by(edge, "_pos").alias("first"), F.max_by(edge, "_pos").alias("last")).collect()
    carried, before, held = [], None, 0
    for r in sorted(edges, key=lambda r: r["_pid"]):  # one row per range
        carry = 0
        if before is not None and (r.first["_k1"], r.first["_k2"]) == before[:2]:
            again = changes and r.first["_c"] == before[2] and not r.first["_f"]  # the run goes on: not a start
            carry = held - again
        carried.append((r["_pid"], int(carry)))
        before, held = (r.last["_k1"], r.last["_k2"], r.last["_c"]), r.last["_n"] + (carry if r.last["_head"] else 0)
    carries = F.broadcast(df.sparkSession.createDataFrame(carried, "_pid long, _carry long"))  # one row per range
    count_here = F.col("_n") + F.when(F.col("_head"), F.col("_carry")).otherwise(F.lit(0))
    return tagged.join(carries, "_pid").select(*[F.col(f"`{c}`") for c in df.columns], count_here.alias(out_col))
