"""Response streams and transcripts.

Rows are chunks/events of a conversation ordered by a sequence.  The reference
folds a streamed answer into chat messages: a chunk joins the last message if
that one is an answer, else it starts a new one; a user message always starts
a new message.  End markers close a response as complete or failed.

Two physical forms for the order-dependent steps, which give the same rows for
every input (NULL keys and NULL types are values of their own in either):

* ``strategy="ranged"`` (default): one range partitioning on key and order with
  carried counts (:func:`revlens.operators.ordered.with_running_count`), so a
  conversation holding a large share of all rows is spread over many tasks;
* ``strategy="window"``: ``lag`` and a running sum over a window partitioned by
  conversation - one shuffle, but one task per conversation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.operators.joins import with_group
from revlens.operators.ordered import with_running_count


def ordered_concat(text_col: str, order_cols: Sequence[str], sep: str = "") -> Column:
    """Aggregate: texts joined in order (A6/A7).  The group is one response or
    one message, whose size is the size of the result itself."""
    key = F.struct(*[F.col(c) for c in order_cols])
    pairs = F.array_sort(F.collect_list(F.struct(key.alias("o"), F.col(text_col).alias("t"))))
    return F.array_join(F.transform(pairs, lambda x: x["t"]), sep)


def _running(df: DataFrame, key_cols, order_cols, flag: Column, change_col: str | None, strategy: str) -> DataFrame:
    """Add ``_run``: the key's rows up to this one that start something."""
    if strategy == "ranged":
        return with_running_count(df, key_cols, order_cols, flag, change_col, "_run")
    if strategy != "window":
        raise ValueError(f"unknown strategy {strategy}")
    w = Window.partitionBy(*key_cols).orderBy(*order_cols)
    start = F.coalesce(flag, F.lit(False))
    if change_col:
        start = start | (F.row_number().over(w) == 1) | ~F.col(f"`{change_col}`").eqNullSafe(F.lag(f"`{change_col}`").over(w))
    out = df.withColumn("_start", start.cast("bigint"))
    return out.withColumn("_run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


def fold_runs(
    df: DataFrame,
    key_cols: Sequence[str],
    order_cols: Sequence[str],
    type_col: str,
    aggs: Sequence[Column],
    always_new: Sequence[str] = (),
    strategy: str = "ranged",
    msg_col: str = "msg_no",
) -> DataFrame:
    """Merge consecutive rows of the same type into one message per run.

    Rows whose type is in ``always_new`` each start their own message (user
    turns).  Returns ``key_cols, msg_no, type`` and ``aggs`` per message;
    ``msg_no`` counts messages from 0 within the key.  Select only the
    columns the aggregates need first: the ranged form checkpoints its input.
    """
    key_cols = list(key_cols)
    single = F.col(type_col).isin(list(always_new)) if always_new else F.lit(False)
    runs = _running(df, key_cols, order_cols, single, type_col, strategy)
    return runs.withColumn(msg_col, F.col("_run") - 1).groupBy(*key_cols, type_col, msg_col).agg(*aggs)


def response_status(
    df: DataFrame,
    key_cols: Sequence[str],
    order_cols: Sequence[str],
    kind_col: str,
    end_kind: str,
    error_kind: str,
    aggs: Sequence[Column] = (),
    strategy: str = "ranged",
) -> DataFrame:
    """One row per response: ``key_cols, response_no, status, n_chunks`` + aggs.

    ``response_no`` of a row = number of end markers (either kind) before it
    in its key; a marker closes the response it belongs to.  Status is
    ``complete`` / ``error`` from the closing marker, else ``open``.  Marker
    rows are not chunks.
    """
    key_cols = list(key_cols)
    is_marker = F.coalesce(F.col(kind_col).isin([end_kind, error_kind]), F.lit(False))  # a NULL kind is a chunk
    marked = _running(df.withColumn("_marker", is_marker), key_cols, order_cols, F.col("_marker"), None, strategy)
    resp = F.col("_run") - F.col("_marker").cast("bigint")  # markers before the row
    closing = F.max(
        F.when(F.col(kind_col) == end_kind, F.lit(2)).when(F.col(kind_col) == error_kind, F.lit(1))
    )
    return (
        marked.withColumn("response_no", resp)
        .groupBy(*key_cols, "response_no")
        .agg(closing.alias("_close"), F.count_if(~F.col("_marker")).alias("n_chunks"), *aggs)
        .withColumn(
            "status",
            F.when(F.col("_close") == 2, F.lit("complete")).when(F.col("_close") == 1, F.lit("error"))
            .otherwise(F.lit("open")),
        )
        .drop("_close")
    )


def after_last(df: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str], is_reset: Column) -> DataFrame:
    """Rows after the last reset row of their key (T5, clear chat); keys
    without a reset keep all rows.  The last reset per key is a partial
    aggregate joined back (no window)."""
    key_cols = list(key_cols)
    pos = F.struct(*[F.col(c) for c in order_cols])
    last = df.where(is_reset).groupBy(*key_cols).agg(F.max(pos).alias("_last_reset"))
    return (
        with_group(df, last, key_cols)
        .where(F.col("_last_reset").isNull() | (pos > F.col("_last_reset")))
        .drop("_last_reset")
    )


def drop_after_first(df: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str], is_stop: Column,
                     inclusive: bool = True) -> DataFrame:
    """Rows up to (and with ``inclusive`` including) the first stop row of each
    key (T4: nothing is sent after an error end)."""
    key_cols = list(key_cols)
    pos = F.struct(*[F.col(c) for c in order_cols])
    first = df.where(is_stop).groupBy(*key_cols).agg(F.min(pos).alias("_first_stop"))
    keep = (pos <= F.col("_first_stop")) if inclusive else (pos < F.col("_first_stop"))
    return with_group(df, first, key_cols).where(F.col("_first_stop").isNull() | keep).drop("_first_stop")


def tumbling_concat(
    df: DataFrame, key_cols: Sequence[str], ts_col: str, text_col: str, order_cols: Sequence[str],
    duration: str, sep: str = "",
) -> DataFrame:
    """Buffered flush (T6) in batch form: per key and tumbling time window,
    the number of chunks and their text in order."""
    return df.groupBy(*key_cols, F.window(ts_col, duration).start.alias("window_start")).agg(
        F.count(F.lit(1)).alias("n_chunks"), ordered_concat(text_col, order_cols, sep).alias("content")
    )


def non_empty(df: DataFrame, text_col: str) -> DataFrame:
    """F8: drop empty chunks (a chunk of blanks is kept)."""
    return df.where(F.length(text_col) > 0)
