"""Page, HTML and file queries."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from revlens.functions.casts import safe_double, safe_int
from revlens.functions.text import file_name_for
from revlens.operators.html import FieldSpec, extract_records
from revlens.operators.pivot import pivot_last
from revlens.session import load_table, scratch_path
from revlens.sources.csv import read_csv_folder, write_entity_csv
from revlens.sources.pages import page_plan, stop_at_first_failure

MAX_PAGES = 20
BASE_URL = "https://reviews.example/"
EVENT_TYPES = ["click", "view", "error", "signup", "purchase", "refund"]  # "refund" never occurs: NULL column
PART_CSV_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_retailprice"]


def q_page_plan(spark: SparkSession, sf_dir: str):
    seeds = load_table(spark, sf_dir, "nation").select(
        "n_name", F.concat(F.lit(BASE_URL), F.lower("n_name")).alias("base_url"))
    return page_plan(seeds, "n_name", "base_url", MAX_PAGES).select("entity", F.col("page").cast("int"), "url")


def q_stop_at_first_failure(spark, sf_dir):
    e = load_table(spark, sf_dir, "events")
    kept = stop_at_first_failure(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")
    return kept.select("event_id", "user_id", "event_type")


def q_stop_null_keys(spark, sf_dir):
    e = load_table(spark, sf_dir, "events").select("event_id", "ts", "event_type", F.when(F.col("user_id") % 7 != 0, F.col("user_id")).alias("key"))
    return stop_at_first_failure(e, ["key"], ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "key", "event_type")


def q_entity_file_name(spark, sf_dir):
    p = load_table(spark, sf_dir, "part")
    return p.groupBy(file_name_for("p_name").alias("file_name")).agg(F.count(F.lit(1)).alias("n_rows"))


def q_csv_roundtrip(spark, sf_dir):
    p = load_table(spark, sf_dir, "part").select(*PART_CSV_COLUMNS)
    path = scratch_path(spark, "part-csv")
    write_entity_csv(p, "p_name", path, file_col="source_file")
    back = read_csv_folder(spark, path, PART_CSV_COLUMNS, file_col="source_file")
    return back.select(
        safe_int("p_partkey").alias("p_partkey"), "p_name", "p_brand", "p_type",
        safe_double("p_retailprice").alias("p_retailprice"), "source_file",
    )


def q_html_records(spark, sf_dir):
    pages = load_table(spark, sf_dir, "pages")
    fields = [FieldSpec("href", "a", kind="attr:href"), FieldSpec("link_text", "a")]
    recs = extract_records(pages, "html", "li", fields, keep=["page_id"])
    return recs.select("page_id", "record_no", "href", "link_text")


def q_html_title(spark, sf_dir):
    pages = load_table(spark, sf_dir, "pages")
    fields = [FieldSpec("title", "title"), FieldSpec("heading", "h1")]
    return extract_records(pages, "html", None, fields, keep=["page_id"]).select("page_id", "title", "heading")


def q_html_tag_count(spark, sf_dir):
    pages = load_table(spark, sf_dir, "pages")
    fields = [FieldSpec("n_p", "p", kind="count"), FieldSpec("n_li", "li", kind="count"),
              FieldSpec("n_a", "a", kind="count"), FieldSpec("n_br", "br", kind="count")]
    return extract_records(pages, "html", None, fields, keep=["page_id"]).select("page_id", "n_p", "n_li", "n_a", "n_br")


def q_pivot_last_wins(spark, sf_dir):
    e = load_table(spark, sf_dir, "events")
    return pivot_last(e, ["user_id"], "event_type", "value", ["ts", "event_id"], EVENT_TYPES)


QUERIES = {
    "page_plan": q_page_plan,
    "stop_at_first_failure": q_stop_at_first_failure,
    "stop_null_keys": q_stop_null_keys,
    "entity_file_name": q_entity_file_name,
    "csv_roundtrip": q_csv_roundtrip,
    "html_records": q_html_records,
    "html_title": q_html_title,
    "html_tag_count": q_html_tag_count,
    "pivot_last_wins": q_pivot_last_wins,
}

# ---------------------------------------------------------------- oracles


def _unescape(x: str) -> str:
    """HTML5 decoding of the only entities in these pages; like the HTML
    parser, the legacy names also decode without their semicolon.  One
    regex pass per name, ``amp`` last, so a decoded ``&`` never starts a new
    entity."""
    out = x
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        out = f"regexp_replace({out}, '&{name};?', '{char}', 'g')"
    return out


def _first(tag: str) -> str:
    inner = f"regexp_extract(html, '<{tag}>(.*?)</{tag}>', 1)"
    return (f"CASE WHEN regexp_matches(html, '<{tag}>') THEN "
            f"{_unescape(f'regexp_replace({inner}, {chr(39)}<[^>]*>{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})')}"
            f" END")


def _count(tag: str) -> str:
    return f"CAST(len(regexp_extract_all(html, '<{tag}[\\s>/]')) AS INTEGER)"


ORACLES = {
    "page_plan": f"""
SELECT n_name AS entity, CAST(page AS INTEGER) AS page,
       concat('{BASE_URL}', lower(n_name), '/page/', CAST(page AS VARCHAR), '/') AS url
FROM nation, range(1, {MAX_PAGES + 1}) t(page)""",
    "stop_null_keys": """
WITH e AS (SELECT event_id, ts, event_type, CASE WHEN user_id % 7 <> 0 THEN user_id END AS key FROM events),
f AS (SELECT key, min((ts, event_id)) AS fail FROM e WHERE event_type = 'error' GROUP BY key)
SELECT e.event_id, e.key, e.event_type FROM e LEFT JOIN f ON e.key IS NOT DISTINCT FROM f.key
WHERE f.fail IS NULL OR (e.ts, e.event_id) < f.fail""",
    "stop_at_first_failure": """
WITH f AS (SELECT user_id, ts AS fts, event_id AS fid
           FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
                 FROM events WHERE event_type = 'error') WHERE rn = 1)
SELECT e.event_id, e.user_id, e.event_type FROM events e LEFT JOIN f USING (user_id)
WHERE f.fts IS NULL OR e.ts < f.fts OR (e.ts = f.fts AND e.event_id < f.fid)""",
    "entity_file_name": """
SELECT concat(replace(p_name, ' ', '_'), '_reviews.csv') AS file_name, count(*) AS n_rows FROM part GROUP BY 1""",
    "csv_roundtrip": """
SELECT p_partkey, p_name, p_brand, p_type, p_retailprice, concat(replace(p_name, ' ', '_'), '_reviews.csv') AS source_file
FROM part""",
    "html_records": f"""
WITH li AS (SELECT page_id, unnest(regexp_extract_all(html, '<li>(.*?)</li>', 1)) AS inner_html,
                   unnest(generate_series(0, len(regexp_extract_all(html, '<li>(.*?)</li>', 1)) - 1)) AS record_no
            FROM pages)
SELECT page_id, CAST(record_no AS INTEGER) AS record_no,
       CASE WHEN regexp_matches(inner_html, '<a ') THEN {_unescape("regexp_extract(inner_html, 'href=\"([^\"]*)\"', 1)")} END AS href,
       CASE WHEN regexp_matches(inner_html, '<a[ >]') THEN
            {_unescape("regexp_replace(regexp_extract(inner_html, '<a[^>]*>(.*?)</a>', 1), '<[^>]*>', '', 'g')")} END AS link_text
FROM li""",
    "html_title": f"SELECT page_id, {_first('title')} AS title, {_first('h1')} AS heading FROM pages",
    "html_tag_count": f"""
SELECT page_id, {_count('p')} AS n_p, {_count('li')} AS n_li, {_count('a')} AS n_a, {_count('br')} AS n_br FROM pages""",
    "pivot_last_wins": "SELECT user_id, " + ", ".join(
        f"arg_max(value, (ts, event_id)) FILTER (WHERE event_type = '{t}') AS {t}" for t in EVENT_TYPES
    ) + " FROM events GROUP BY user_id",
}
