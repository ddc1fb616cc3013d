"""Transcript and response-stream queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.operators.transcript import (
    after_last, drop_after_first, fold_runs, non_empty, ordered_concat, response_status, tumbling_concat,
)
from revlens.session import load_table

ALWAYS_NEW = ["signup"]  # plays the role of a user message: never merged
END_KIND, ERROR_KIND = "purchase", "error"
FLUSH_WINDOW = "1 hour"


def _event_runs(spark, sf_dir, strategy):
    # project first: an eager checkpoint in the ranged form keeps every column
    e = load_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    pos = F.struct("ts", "event_id")
    aggs = [
        F.count(F.lit(1)).alias("n_events"),
        F.min_by("event_id", pos).alias("first_event_id"),
        F.max_by("event_id", pos).alias("last_event_id"),
        F.round(F.sum("value"), 6).alias("total_value"),
    ]
    runs = fold_runs(e, ["user_id"], ["ts", "event_id"], "event_type", aggs, ALWAYS_NEW, strategy=strategy)
    return runs.select("user_id", F.col("msg_no").cast("int"), "event_type", "n_events", "first_event_id",
                       "last_event_id", "total_value")


def q_fold_runs(spark, sf_dir):
    return _event_runs(spark, sf_dir, "ranged")


def q_fold_runs_window(spark, sf_dir):
    return _event_runs(spark, sf_dir, "window")


def _status(spark, sf_dir, strategy):
    e = load_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    s = response_status(e, ["user_id"], ["ts", "event_id"], "event_type", END_KIND, ERROR_KIND, strategy=strategy)
    return s.select("user_id", F.col("response_no").cast("int"), "status", "n_chunks")


def q_response_status(spark, sf_dir):
    return _status(spark, sf_dir, "ranged")


def q_response_status_window(spark, sf_dir):
    return _status(spark, sf_dir, "window")


def q_after_last_reset(spark, sf_dir):
    e = load_table(spark, sf_dir, "events")
    return after_last(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup").select(
        "event_id", "user_id")


def _some_null(spark, sf_dir):
    """Events whose key is NULL for one user in seven."""
    e = load_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return e.withColumn("key", F.when(F.col("user_id") % 7 != 0, F.col("user_id")))


def q_after_last_null_keys(spark, sf_dir):
    return after_last(_some_null(spark, sf_dir), ["key"], ["ts", "event_id"], F.col("event_type") == "signup").select("event_id", "key")


def q_drop_after_first(spark, sf_dir):
    """T4: nothing is sent after a key's first error end, which is sent itself."""
    return drop_after_first(_some_null(spark, sf_dir), ["key"], ["ts", "event_id"], F.col("event_type") == ERROR_KIND).select("event_id", "key")


def q_tumbling_concat(spark, sf_dir):
    e = load_table(spark, sf_dir, "events")
    return tumbling_concat(e, ["user_id"], "ts", "event_type", ["ts", "event_id"], FLUSH_WINDOW, ",")


def q_response_concat(spark, sf_dir):
    c = non_empty(load_table(spark, sf_dir, "conversations"), "text")
    return c.groupBy("conv_id", "role").agg(
        F.count(F.lit(1)).alias("n_chunks"), ordered_concat("text", ["turn"], "").alias("content"))


def q_transcript_fold(spark, sf_dir):
    """Assistant turns streamed line by line, folded back into messages."""
    c = load_table(spark, sf_dir, "conversations")
    chunks = c.select(
        "conv_id", "turn", "role",
        F.when(F.col("role") == "user", F.array("text")).otherwise(F.split("text", "\n")).alias("parts"),
    ).select("conv_id", "turn", "role", F.posexplode("parts").alias("part_no", "text"))
    chunks = non_empty(chunks.withColumn("type", F.when(F.col("role") == "user", "user").otherwise("ai")), "text")
    aggs = [F.count(F.lit(1)).alias("n_chunks"), ordered_concat("text", ["turn", "part_no"], "").alias("content")]
    msgs = fold_runs(chunks, ["conv_id"], ["turn", "part_no"], "type", aggs, ["user"])
    return msgs.select("conv_id", F.col("msg_no").cast("int"), "type", "n_chunks", "content")


QUERIES = {
    "fold_runs": q_fold_runs,
    "fold_runs_window": q_fold_runs_window,
    "response_status": q_response_status,
    "response_status_window": q_response_status_window,
    "after_last_reset": q_after_last_reset,
    "after_last_null_keys": q_after_last_null_keys,
    "drop_after_first": q_drop_after_first,
    "tumbling_concat": q_tumbling_concat,
    "response_concat": q_response_concat,
    "transcript_fold": q_transcript_fold,
}

# ---------------------------------------------------------------- oracles

_FOLD = f"""
WITH s AS (SELECT *, CASE WHEN event_type IN ({", ".join(f"'{t}'" for t in ALWAYS_NEW)})
                            OR lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS new_msg
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
m AS (SELECT *, sum(new_msg) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS msg_no
      FROM s)
SELECT user_id, CAST(msg_no AS INTEGER) AS msg_no, any_value(event_type) AS event_type, count(*) AS n_events,
       arg_min(event_id, (ts, event_id)) AS first_event_id, arg_max(event_id, (ts, event_id)) AS last_event_id,
       round(sum(value), 6) AS total_value
FROM m GROUP BY user_id, msg_no"""

_STATUS = f"""
WITH m AS (SELECT *, event_type IN ('{END_KIND}', '{ERROR_KIND}') AS is_m FROM events),
r AS (SELECT *, coalesce(sum(CASE WHEN is_m THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS response_no FROM m)
SELECT user_id, CAST(response_no AS INTEGER) AS response_no,
       CASE max(CASE event_type WHEN '{END_KIND}' THEN 2 WHEN '{ERROR_KIND}' THEN 1 END)
            WHEN 2 THEN 'complete' WHEN 1 THEN 'error' ELSE 'open' END AS status,
       count(*) FILTER (WHERE NOT is_m) AS n_chunks
FROM r GROUP BY user_id, response_no"""

_TRANSCRIPT = """
WITH parts AS (
  SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'ai' END AS type,
         unnest(CASE WHEN role = 'user' THEN [text] ELSE string_split(text, chr(10)) END) AS text,
         unnest(generate_series(0, len(CASE WHEN role = 'user' THEN [text] ELSE string_split(text, chr(10)) END) - 1))
           AS part_no
  FROM conversations),
c AS (SELECT * FROM parts WHERE length(text) > 0),
s AS (SELECT *, CASE WHEN type = 'user' OR lag(type) OVER w IS DISTINCT FROM type THEN 1 ELSE 0 END AS new_msg
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, part_no)),
m AS (SELECT *, sum(new_msg) OVER (PARTITION BY conv_id ORDER BY turn, part_no ROWS UNBOUNDED PRECEDING) - 1 AS msg_no
      FROM s)
SELECT conv_id, CAST(msg_no AS INTEGER) AS msg_no, any_value(type) AS type, count(*) AS n_chunks,
       string_agg(text, '' ORDER BY turn, part_no) AS content
FROM m GROUP BY conv_id, msg_no"""

_SOME_NULL = "e AS (SELECT event_id, ts, event_type, CASE WHEN user_id % 7 <> 0 THEN user_id END AS key FROM events)"

ORACLES = {
    "after_last_null_keys": f"""
WITH {_SOME_NULL}, l AS (SELECT key, max((ts, event_id)) AS last_reset FROM e WHERE event_type = 'signup' GROUP BY key)
SELECT e.event_id, e.key FROM e LEFT JOIN l ON e.key IS NOT DISTINCT FROM l.key
WHERE l.last_reset IS NULL OR (e.ts, e.event_id) > l.last_reset""",
    "drop_after_first": f"""
WITH {_SOME_NULL}, l AS (SELECT key, min((ts, event_id)) AS stop FROM e WHERE event_type = '{ERROR_KIND}' GROUP BY key)
SELECT e.event_id, e.key FROM e LEFT JOIN l ON e.key IS NOT DISTINCT FROM l.key
WHERE l.stop IS NULL OR (e.ts, e.event_id) <= l.stop""",
    "fold_runs": _FOLD,
    "fold_runs_window": _FOLD,
    "response_status": _STATUS,
    "response_status_window": _STATUS,
    "after_last_reset": """
WITH l AS (SELECT user_id, max((ts, event_id)) AS last_reset FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT e.event_id, e.user_id FROM events e LEFT JOIN l USING (user_id)
WHERE l.last_reset IS NULL OR (e.ts, e.event_id) > l.last_reset""",
    "tumbling_concat": f"""
SELECT user_id, time_bucket(INTERVAL '{FLUSH_WINDOW}', ts) AS window_start, count(*) AS n_chunks,
       string_agg(event_type, ',' ORDER BY ts, event_id) AS content
FROM events GROUP BY ALL""",
    "response_concat": """
SELECT conv_id, role, count(*) AS n_chunks, string_agg(text, '' ORDER BY turn) AS content
FROM conversations WHERE length(text) > 0 GROUP BY conv_id, role""",
    "transcript_fold": _TRANSCRIPT,
}
