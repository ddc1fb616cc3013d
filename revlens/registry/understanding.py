"""Question understanding and index queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.operators.joins import spread
from revlens.operators.ordered import with_row_index
from revlens.operators.understand import extract_vocab, parse_model_json, route_match, unsupported, validate
from revlens.operators.vocabulary import match_vocabulary, sequences
from revlens.registry.common import sql_str, sql_strip, sql_vocab_match
from revlens.session import load_table, scratch_path
from revlens.sources.buckets import read_buckets, upsert_buckets
from revlens.sources.index import upsert

# Vocabularies for matching part names as if they were questions: one kind
# with multi-word entries (longest wins at a position), two attribute kinds
# whose canonical values differ in case from the text.
PART_VOCAB = {
    "entity": ["red widget", "blue bolt", "hot plate", "widget", "bolt", "plate", "gear", "ring", "rod", "anvil",
               "gizmo"],
    "size_kind": [("small", "Small"), ("large", "Large"), ("new", "New"), ("old", "Old")],
    "tone_kind": [("red", "Red"), ("blue", "Blue"), ("hot", "Hot"), ("cold", "Cold")],
}
ASPECT_VOCAB = [("economy", "price"), ("promo", "price"), ("standard", "comfort"), ("medium", "room"), ("large", "room"), ("small", "room")]
UNSUPPORTED_REGION = "MIDDLE EAST"  # nations of this region are indexed but not supported


def _pairs(entries):
    return [(e, e) if isinstance(e, str) else e for e in entries]


def q_vocab_extract(spark, sf_dir):
    p = load_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return extract_vocab(p, "p_name", PART_VOCAB).select("p_partkey", *PART_VOCAB.keys())


def _fence_variants(spark, sf_dir) -> DataFrame:
    e = spread(load_table(spark, sf_dir, "events"))
    raw = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
        .when(F.col("event_type") == "view", F.concat(F.lit("```\n"), F.col("props"), F.lit("\n```")))
        .when(F.col("event_type") == "error", F.expr("substring(props, 1, length(props) - 1)"))
        .when(F.col("event_type") == "signup", F.regexp_replace("props", '"', "'"))
        .otherwise(F.concat(F.lit("  "), F.col("props"), F.lit("\n")))
    )
    return e.select("event_id", "event_type", raw.alias("raw"))


def q_fence_json(spark, sf_dir):
    v = _fence_variants(spark, sf_dir)
    parsed = parse_model_json(F.col("raw"), "k string")
    return v.select("event_id", "event_type", parsed["k"].try_cast("bigint").alias("k"))


def _nation_vocab(spark, sf_dir) -> DataFrame:
    n = load_table(spark, sf_dir, "nation")
    r = load_table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).where(F.col("r_name") != UNSUPPORTED_REGION)


def q_validate_vocab(spark, sf_dir):
    c = load_table(spark, sf_dir, "customer").select(
        F.lit("customer").alias("src"), F.col("c_custkey").alias("key"),
        F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("candidate"))
    s = load_table(spark, sf_dir, "supplier").select(
        F.lit("supplier").alias("src"), F.col("s_suppkey").alias("key"),
        F.lower(F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string"))).alias("candidate"))
    supported = _nation_vocab(spark, sf_dir).select("n_name")
    return validate(c.unionByName(s), "candidate", supported, out_col="filter_entity")


def q_unsupported_entities(spark, sf_dir):
    c = load_table(spark, sf_dir, "customer")
    n = load_table(spark, sf_dir, "nation")
    indexed = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("n_name").alias("entity"))
    return unsupported(indexed, "entity", _nation_vocab(spark, sf_dir).select("n_name"))


def q_supported_entities(spark, sf_dir):
    v = _nation_vocab(spark, sf_dir).select("n_nationkey", F.col("n_name").alias("entity"))
    return with_row_index(v, ["n_nationkey"], "ordinal").select(F.col("ordinal").cast("int"), "entity")


def q_upsert_latest(spark, sf_dir):
    o = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    base = o.select("o_orderkey", "o_totalprice", "o_orderstatus", F.lit(0).alias("version"))
    urgent = o.where(F.col("o_orderpriority") == "1-URGENT")
    low = o.where(F.col("o_orderpriority") == "5-LOW")
    batch = (
        urgent.select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), "o_orderstatus",
                      F.lit(1).alias("version"))
        .unionByName(urgent.select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"),
                                   F.lit("U").alias("o_orderstatus"), F.lit(2).alias("version")))
        .unionByName(low.select((-(F.col("o_orderkey") + 1)).alias("o_orderkey"), "o_totalprice", "o_orderstatus",
                                F.lit(1).alias("version")))
    )
    merged = upsert(base, batch, "o_orderkey", seq_col="version")
    return merged.select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"), "o_orderstatus", "version")


def q_upsert_null_versions(spark, sf_dir):
    """Versions that are NULL (below any other) for urgent orders, a second one with a version for every third of these."""
    o = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    base = o.select("o_orderkey", "o_totalprice", "o_orderstatus", F.lit(0).alias("version"))
    urgent = o.where(F.col("o_orderpriority") == "1-URGENT")
    batch = urgent.select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), "o_orderstatus", F.lit(None).cast("int").alias("version"))
    batch = batch.unionByName(urgent.where("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit("U").alias("o_orderstatus"), F.lit(-5).alias("version")))
    merged = upsert(base, batch, "o_orderkey", seq_col="version")
    return merged.select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"), "o_orderstatus", "version")


def q_vocab_large(spark, sf_dir):
    """Every two and three consecutive words of a conversation are a vocabulary entry, whose value is the least conversation
    that has them; matched against whole documents."""
    turns = spread(load_table(spark, sf_dir, "conversations"))
    vocab = turns.select("conv_id", F.inline(sequences("text", (2, 3)))).withColumnRenamed("entry", "surface")
    vocab = vocab.groupBy("surface").agg(F.min("conv_id").alias("value"))
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    return match_vocabulary(docs, "doc_id", "text", vocab, "surface", "value").drop("text")


def q_upsert_buckets(spark, sf_dir):
    """All documents, then a batch in which those of one language move to another one (and come a second time without a
    version) and those of another language come as new ids."""
    d = load_table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    path = scratch_path(spark, "buckets")
    upsert_buckets(spark, path, d.withColumn("version", F.lit(0)), "doc_id", ["lang"], "version")
    moved = d.where("lang = 'fr'")
    batch = moved.withColumns({"lang": F.lit("es"), "version": F.lit(1)}).unionByName(
        moved.withColumns({"n_chars": -F.col("n_chars"), "version": F.lit(None).cast("int")})).unionByName(
        d.where("lang = 'de'").withColumns({"doc_id": -F.col("doc_id") - 1, "version": F.lit(None).cast("int")}))
    upsert_buckets(spark, path, batch, "doc_id", ["lang"], "version")
    return read_buckets(spark, path).select("doc_id", "lang", "n_chars", "version")


def q_question_fields(spark, sf_dir):
    """All five fields of a question: entity, two kinds, route and aspect; small parts are asked about without a route."""
    p = load_table(spark, sf_dir, "part")
    route = F.when(F.col("p_size") > 10, F.concat(F.lit(" from "), "p_brand", F.lit("  to "), "p_type")).otherwise("")
    asked = p.select("p_partkey", F.concat(F.lit("How is the "), F.lower("p_type"), F.lit(" ("), "p_name", F.lit(")"), route, F.lit("?")).alias("question"))
    fields = extract_vocab(asked, "question", PART_VOCAB | {"aspect": ASPECT_VOCAB})
    return fields.select("p_partkey", *PART_VOCAB, "aspect", route_match("question").alias("route"))


QUERIES = {
    "question_fields": q_question_fields,
    "upsert_buckets": q_upsert_buckets,
    "vocab_large": q_vocab_large,
    "vocab_extract": q_vocab_extract,
    "fence_json": q_fence_json,
    "validate_vocab": q_validate_vocab,
    "unsupported_entities": q_unsupported_entities,
    "supported_entities": q_supported_entities,
    "upsert_latest": q_upsert_latest,
    "upsert_null_versions": q_upsert_null_versions,
}

# ---------------------------------------------------------------- oracles

_VOCAB_SQL = ", ".join(f"{sql_vocab_match('p_name', _pairs(v))} AS {k}" for k, v in PART_VOCAB.items())

_FENCE = f"""
WITH v AS (
  SELECT event_id, event_type,
         CASE event_type
           WHEN 'click' THEN concat('```json', chr(10), props, chr(10), '```')
           WHEN 'view' THEN concat('```', chr(10), props, chr(10), '```')
           WHEN 'error' THEN substr(props, 1, length(props) - 1)
           WHEN 'signup' THEN replace(props, '"', '''')
           ELSE concat('  ', props, chr(10)) END AS raw
  FROM events),
s1 AS (SELECT *, {sql_strip('raw')} AS c1 FROM v),
s2 AS (SELECT *, CASE WHEN starts_with(c1, '```json') THEN split_part(c1, '```json', 2) ELSE c1 END AS c2 FROM s1),
s3 AS (SELECT *, CASE WHEN ends_with(c2, '```') THEN c2[1:length(c2) - 3] ELSE c2 END AS c3 FROM s2)
SELECT event_id, event_type,
       CASE WHEN regexp_matches(c3, {sql_str(r'(?s)\A\s*\{.*\}\s*\z')}) AND json_valid(c3)
            THEN TRY_CAST(json_extract_string(c3, '$.k') AS BIGINT) END AS k
FROM s3"""

_NATION_VOCAB = f"""
sup AS (SELECT n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey
        WHERE r_name <> {sql_str(UNSUPPORTED_REGION)})"""

_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def _sql_sequences(table: str, key: str) -> str:
    """Every two and three consecutive words with their place."""
    each = " UNION ALL ".join(
        f"SELECT {key}, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: {{'entry': array_to_string(w[i:i + {n - 1}], ' '), 'place': i}}), recursive := true) FROM t"
        for n in (2, 3))
    return f"(WITH t AS MATERIALIZED (SELECT {key}, {_WORDS} AS w FROM {table}) {each})"


_ASKED = "(SELECT p_partkey, p_size, p_brand, p_type, concat('How is the ', lower(p_type), ' (', p_name, ')', CASE WHEN p_size > 10 THEN concat(' from ', p_brand, '  to ', p_type) ELSE '' END, '?') AS question FROM part)"
_FIELDS_SQL = ", ".join(f"{sql_vocab_match('question', _pairs(v))} AS {k}" for k, v in (PART_VOCAB | {"aspect": ASPECT_VOCAB}).items())

ORACLES = {
    "question_fields": f"SELECT p_partkey, {_FIELDS_SQL}, CASE WHEN p_size > 10 THEN concat(p_brand, ' to ', p_type) END AS route FROM {_ASKED}",
    "upsert_buckets": """
SELECT doc_id, CASE WHEN lang = 'fr' THEN 'es' ELSE lang END AS lang, n_chars, CASE WHEN lang = 'fr' THEN 1 ELSE 0 END AS version FROM documents
UNION ALL SELECT -doc_id - 1, lang, n_chars, NULL FROM documents WHERE lang = 'de'""",
    "vocab_large": f"""
WITH vocab AS (SELECT entry, CAST(min(conv_id) AS VARCHAR) AS value FROM {_sql_sequences('conversations', 'conv_id')} GROUP BY entry),
hits AS (SELECT doc_id, entry, value, min(place) AS place FROM {_sql_sequences('documents', 'doc_id')} JOIN vocab USING (entry) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(entry) DESC, place) AS rank, count(*) OVER (PARTITION BY doc_id) AS n FROM hits)
SELECT doc_id, value, entry, coalesce(n, 0) AS n_found FROM documents LEFT JOIN (SELECT * FROM best WHERE rank = 1) USING (doc_id)""",
    "vocab_extract": f"SELECT p_partkey, {_VOCAB_SQL} FROM part",
    "fence_json": _FENCE,
    "validate_vocab": f"""
WITH {_NATION_VOCAB},
c AS (SELECT 'customer' AS src, c_custkey AS key, concat('NATION_', CAST(c_nationkey AS VARCHAR)) AS candidate FROM customer
      UNION ALL
      SELECT 'supplier', s_suppkey, lower(concat('NATION_', CAST(s_nationkey AS VARCHAR))) FROM supplier)
SELECT src, key, candidate, CASE WHEN candidate IN (SELECT n_name FROM sup) THEN candidate END AS filter_entity FROM c""",
    "unsupported_entities": f"""
WITH {_NATION_VOCAB}
SELECT DISTINCT n_name AS entity FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE n_name NOT IN (SELECT n_name FROM sup)""",
    "supported_entities": f"""
WITH {_NATION_VOCAB}
SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS ordinal, n_name AS entity FROM sup""",
    "upsert_null_versions": """
SELECT o_orderkey, round(CASE WHEN o_orderpriority <> '1-URGENT' THEN o_totalprice WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice + 1 END, 6) AS o_totalprice,
       CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 3 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderpriority <> '1-URGENT' THEN 0 WHEN o_orderkey % 3 = 0 THEN -5 END AS version
FROM orders""",
    "upsert_latest": """
WITH upd AS (
  SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, o_orderstatus, 1 AS version FROM orders
  WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT o_orderkey, o_totalprice * 2, 'U', 2 FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT -(o_orderkey + 1), o_totalprice, o_orderstatus, 1 FROM orders WHERE o_orderpriority = '5-LOW'),
last AS (SELECT o_orderkey, arg_max(o_totalprice, version) AS o_totalprice, arg_max(o_orderstatus, version) AS o_orderstatus,
                max(version) AS version FROM upd GROUP BY o_orderkey)
SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice, o_orderstatus, 0 AS version FROM orders
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM last)
UNION ALL
SELECT o_orderkey, round(o_totalprice, 6), o_orderstatus, version FROM last""",
}
