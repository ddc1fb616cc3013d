"""Cleaning, statistics and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions.casts import (
    month_year, safe_double, safe_int, yes_no,
)
from revlens.functions.text import NA_TOKENS, null_na_tokens, py_strip, replace_values, split_flag_body
from revlens.operators.clean import drop_missing, impute_mean_by_group, metadata_struct
from revlens.operators.embed import batch_numbers
from revlens.operators.joins import spread
from revlens.operators.ordered import with_row_index
from revlens.operators.stats import file_stats, union_by_name
from revlens.registry.common import sql_list, sql_str, sql_strip
from revlens.session import load_table

DEFAULT_CATEGORY = "Not specified"
STATUS_MAP = {"F": "Finished", "O": "O"}  # whole-value replace; "O" maps to itself
EXTRA_NA = ("4-NOT SPECIFIED",)
BATCH_SIZE = 100


def _docs_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    labels = load_table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left")


def q_safe_int(spark, sf_dir):
    p = load_table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    return p.select(
        "p_partkey",
        safe_int(F.substring("p_brand", 7, 100)).alias("brand_num"),
        safe_int("p_name").alias("name_num"),
        safe_int(F.concat(size, F.lit(".0"))).alias("decimal_num"),
        safe_int(F.concat(F.lit(" "), size, F.lit("\n"))).alias("padded_num"),
        safe_int(F.concat(F.lit("+"), size)).alias("signed_num"),
    )


def q_safe_double(spark, sf_dir):
    e = load_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return e.select(
        "event_id",
        safe_double(k).alias("k_num"),
        safe_double("event_type").alias("type_num"),
        safe_double(F.concat(F.lit(" "), k, F.lit("e-1"))).alias("sci_num"),
        safe_double(F.concat(F.lit("."), k)).alias("frac_num"),
    )


def q_month_year_parse(spark, sf_dir):
    o = load_table(spark, sf_dir, "orders")
    full = F.date_format("o_orderdate", "MMMM yyyy")
    return o.select(
        "o_orderkey",
        month_year(full).alias("d_full"),
        month_year(F.lower(full)).alias("d_lower"),
        month_year(F.date_format("o_orderdate", "MMM yyyy")).alias("d_abbrev"),
        month_year(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d_iso"),
        month_year(F.concat(F.lit(" "), full)).alias("d_padded"),
    )


def q_value_replace(spark, sf_dir):
    o = load_table(spark, sf_dir, "orders")
    return o.select("o_orderkey", replace_values("o_orderstatus", STATUS_MAP).alias("status"))


def q_map_bool(spark, sf_dir):
    li = load_table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", yes_no("l_returnflag", "A", "R").alias("flag"))


def q_na_tokens(spark, sf_dir):
    o = load_table(spark, sf_dir, "orders")
    return o.select("o_orderkey", null_na_tokens("o_orderpriority", NA_TOKENS + EXTRA_NA).alias("priority"))


def q_fill_default(spark, sf_dir):
    d = _docs_labels(spark, sf_dir)
    return d.select(
        "doc_id",
        F.coalesce(F.col("quality").cast("string"), F.lit(DEFAULT_CATEGORY)).alias("quality_cat"),
        F.coalesce(F.col("toxic").cast("string"), F.lit(DEFAULT_CATEGORY)).alias("toxic_cat"),
        F.coalesce(F.col("source"), F.lit(DEFAULT_CATEGORY)).alias("source_cat"),
    )


def q_drop_null_keys(spark, sf_dir):
    d = _docs_labels(spark, sf_dir)
    return drop_missing(d, ["text", "quality"]).select("doc_id", "lang", "quality")


def q_mean_impute_by_group(spark, sf_dir):
    d = drop_missing(_docs_labels(spark, sf_dir), ["text"])
    d = d.select("doc_id", "lang", F.col("quality").cast("double").alias("quality"),
                 F.col("toxic").cast("double").alias("toxic"))
    out = impute_mean_by_group(d, ["lang"], ["quality", "toxic"])
    return out.select("doc_id", "lang", F.round("quality", 6).alias("quality"), F.round("toxic", 6).alias("toxic"))


def q_strip_text(spark, sf_dir):
    d = spread(load_table(spark, sf_dir, "documents"))
    padded = F.concat(F.lit("\n \u00a0"), F.col("text"), F.lit("\t\u3000 "))
    s = py_strip(padded)
    return d.select("doc_id", s.alias("stripped"), F.length(s).alias("n_stripped"))


def q_split_flag_body(spark, sf_dir):
    d = spread(load_table(spark, sf_dir, "documents"))
    raw = d.select("doc_id", F.lit("raw").alias("variant"), F.col("text").alias("t"))
    tagged = d.select("doc_id", F.lit("tagged").alias("variant"), F.concat_ws(" | ", "lang", "text").alias("t"))
    both = raw.unionByName(tagged)
    flag, body = split_flag_body("t")
    return both.select("doc_id", "variant", flag.alias("flag"), body.alias("body"))


def q_contiguous_row_id(spark, sf_dir):
    o = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return with_row_index(o, ["o_orderpriority", "o_orderkey"], "row_id")


def q_batch_slices(spark, sf_dir):
    o = load_table(spark, sf_dir, "orders").select("o_orderkey")
    ids = with_row_index(o, ["o_orderkey"], "row_id")
    return ids.groupBy(batch_numbers(ids, "row_id", BATCH_SIZE)).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"),
        F.min("o_orderkey").alias("min_key"), F.max("o_orderkey").alias("max_key"),
    )


def _customer_stats_input(spark, sf_dir):
    c = load_table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_mktsegment").alias("source_file"),
        F.col("c_acctbal").alias("rating"),
        F.when(F.col("c_nationkey") == 0, F.lit("Verified")).otherwise(F.lit("Not Verified")).alias("verification"),
        F.col("c_nationkey").alias("route"),
    )


def q_file_stats(spark, sf_dir):
    s = file_stats(_customer_stats_input(spark, sf_dir), "source_file", "rating", "verification", "route")
    return s.withColumn("avg_rating", F.round("avg_rating", 6))


def q_file_stats_total(spark, sf_dir):
    s = file_stats(_customer_stats_input(spark, sf_dir), "source_file", "rating", "verification", "route",
                   with_total=True)
    return s.withColumn("avg_rating", F.round("avg_rating", 6))


def q_union_by_name(spark, sf_dir):
    c = load_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey"),
        F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"), F.lit("customer").alias("src"),
    )
    s = load_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey"),
        F.col("s_acctbal").alias("acctbal"), F.lit("supplier").alias("src"),
    )
    return union_by_name([c, s])


def q_metadata_struct(spark, sf_dir):
    c = load_table(spark, sf_dir, "customer")
    fields = {"row_id": "c_custkey", "entity": "c_mktsegment", "rating": "c_acctbal",
              "route": "c_nationkey", "review_text": "c_name"}
    return metadata_struct(c, fields).select("metadata.*")


def q_nonblank(spark, sf_dir):
    cv = load_table(spark, sf_dir, "conversations")
    blanked = F.when(F.col("role") == "user", F.col("text")).otherwise(
        F.repeat(F.lit(" \t\n\u00a0"), F.col("turn").cast("int"))
    )
    t = cv.select("conv_id", "turn", "role", blanked.alias("text"))
    return t.where(F.length(py_strip("text")) > 0).select("conv_id", "turn", "role")


QUERIES = {
    "safe_int": q_safe_int,
    "safe_double": q_safe_double,
    "month_year_parse": q_month_year_parse,
    "value_replace": q_value_replace,
    "map_bool": q_map_bool,
    "na_tokens": q_na_tokens,
    "fill_default": q_fill_default,
    "drop_null_keys": q_drop_null_keys,
    "mean_impute_by_group": q_mean_impute_by_group,
    "strip_text": q_strip_text,
    "split_flag_body": q_split_flag_body,
    "contiguous_row_id": q_contiguous_row_id,
    "batch_slices": q_batch_slices,
    "file_stats": q_file_stats,
    "file_stats_total": q_file_stats_total,
    "union_by_name": q_union_by_name,
    "metadata_struct": q_metadata_struct,
    "nonblank": q_nonblank,
}

# ---------------------------------------------------------------- oracles


def _sint(x: str) -> str:
    return f"CASE WHEN regexp_full_match({sql_strip(x)}, '[-+]?[0-9]+') THEN TRY_CAST({sql_strip(x)} AS BIGINT) END"


def _sdbl(x: str) -> str:
    number = "[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?"
    return f"CASE WHEN regexp_full_match({sql_strip(x)}, '{number}') THEN TRY_CAST({sql_strip(x)} AS DOUBLE) END"


def _my(x: str) -> str:
    return (f"CASE WHEN regexp_full_match({x}, '[[:alpha:]]+ [0-9][0-9][0-9][0-9]') "
            f"THEN CAST(try_strptime({x}, '%B %Y') AS DATE) END")


_SIZE = "CAST(p_size AS VARCHAR)"
_K = "json_extract_string(props, '$.k')"
_FULL = "strftime(o_orderdate, '%B %Y')"
_PAD = "concat(chr(10), ' ', chr(160), text, chr(9), chr(12288), ' ')"

ORACLES = {
    "safe_int": f"""
SELECT p_partkey, {_sint('substr(p_brand, 7, 100)')} AS brand_num, {_sint('p_name')} AS name_num,
       {_sint(f"concat({_SIZE}, '.0')")} AS decimal_num, {_sint(f"concat(' ', {_SIZE}, chr(10))")} AS padded_num,
       {_sint(f"concat('+', {_SIZE})")} AS signed_num
FROM part""",
    "safe_double": f"""
SELECT event_id, {_sdbl(_K)} AS k_num, {_sdbl('event_type')} AS type_num,
       {_sdbl(f"concat(' ', {_K}, 'e-1')")} AS sci_num, {_sdbl(f"concat('.', {_K})")} AS frac_num
FROM events""",
    "month_year_parse": f"""
SELECT o_orderkey, {_my(_FULL)} AS d_full, {_my(f'lower({_FULL})')} AS d_lower,
       {_my("strftime(o_orderdate, '%b %Y')")} AS d_abbrev, {_my("strftime(o_orderdate, '%Y-%m-%d')")} AS d_iso,
       {_my(f"concat(' ', {_FULL})")} AS d_padded
FROM orders""",
    "value_replace": """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'O' ELSE o_orderstatus END AS status
FROM orders""",
    "map_bool": """
SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS flag FROM lineitem""",
    "na_tokens": f"""
SELECT o_orderkey, CASE WHEN o_orderpriority IN ({sql_list(NA_TOKENS + EXTRA_NA)}) THEN NULL ELSE o_orderpriority END
       AS priority
FROM orders""",
    "fill_default": f"""
SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), {sql_str(DEFAULT_CATEGORY)}) AS quality_cat,
       coalesce(CAST(l.toxic AS VARCHAR), {sql_str(DEFAULT_CATEGORY)}) AS toxic_cat,
       coalesce(d.source, {sql_str(DEFAULT_CATEGORY)}) AS source_cat
FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "drop_null_keys": """
SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE d.text IS NOT NULL AND l.quality IS NOT NULL""",
    "mean_impute_by_group": """
WITH d AS (SELECT d.doc_id, d.lang, CAST(l.quality AS DOUBLE) AS quality, CAST(l.toxic AS DOUBLE) AS toxic
           FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.text IS NOT NULL)
SELECT doc_id, lang, round(coalesce(quality, avg(quality) OVER (PARTITION BY lang)), 6) AS quality,
       round(coalesce(toxic, avg(toxic) OVER (PARTITION BY lang)), 6) AS toxic
FROM d""",
    "strip_text": f"""
SELECT doc_id, {sql_strip(_PAD)} AS stripped, CAST(length({sql_strip(_PAD)}) AS INTEGER) AS n_stripped FROM documents""",
    "split_flag_body": f"""
WITH t AS (SELECT doc_id, 'raw' AS variant, text AS t FROM documents
           UNION ALL SELECT doc_id, 'tagged', concat_ws(' | ', lang, text) FROM documents),
p AS (SELECT doc_id, variant, string_split(t, '|') AS pieces FROM t)
SELECT doc_id, variant, CASE WHEN len(pieces) = 2 THEN {sql_strip('pieces[1]')} END AS flag,
       {sql_strip('pieces[-1]')} AS body
FROM p""",
    "contiguous_row_id": """
SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS row_id FROM orders""",
    "batch_slices": f"""
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders)
SELECT CAST(floor(row_id / {BATCH_SIZE}) AS BIGINT) AS batch_no, count(*) AS n_rows, min(row_id) AS first_row,
       max(row_id) AS last_row, min(o_orderkey) AS min_key, max(o_orderkey) AS max_key
FROM r GROUP BY 1""",
    "file_stats": """
SELECT c_mktsegment AS source_file, count(*) AS n_reviews, round(avg(c_acctbal), 6) AS avg_rating,
       count(*) FILTER (WHERE c_nationkey = 0) AS n_verified, count(DISTINCT c_nationkey) AS n_routes
FROM customer GROUP BY c_mktsegment""",
    "file_stats_total": """
SELECT c_mktsegment AS source_file, grouping(c_mktsegment) = 1 AS is_total, count(*) AS n_reviews, round(avg(c_acctbal), 6) AS avg_rating,
       count(*) FILTER (WHERE c_nationkey = 0) AS n_verified, count(DISTINCT c_nationkey) AS n_routes
FROM customer GROUP BY ROLLUP (c_mktsegment)""",
    "union_by_name": """
SELECT c_custkey AS key, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal, c_mktsegment AS segment,
       'customer' AS src FROM customer
UNION ALL
SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL, 'supplier' FROM supplier""",
    "metadata_struct": """
SELECT c_custkey AS row_id, c_mktsegment AS entity, c_acctbal AS rating, c_nationkey AS route, c_name AS review_text
FROM customer""",
    "nonblank": f"""
WITH t AS (SELECT conv_id, turn, role,
                  CASE WHEN role = 'user' THEN text ELSE repeat(concat(' ', chr(9), chr(10), chr(160)), CAST(turn AS INTEGER)) END
                  AS text
           FROM conversations)
SELECT conv_id, turn, role FROM t WHERE length({sql_strip('text')}) > 0""",
}
