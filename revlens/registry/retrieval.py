"""Retrieval, embedding and prompt queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions.text import py_strip, words
from revlens.operators import clustered, semantic
from revlens.operators.embed import embed_with, hashed_sparse, hashed_with_rejects
from revlens.operators.html import FieldSpec, extract_records
from revlens.operators.joins import spread
from revlens.operators.retrieve import attach_matches, group_centroids, topk_cosine
from revlens.plans.answer import AnswerConfig, answer_text_questions, match_arrays
from revlens.plans.build_index import build_index
from revlens.registry.common import (
    DIM, LANG_VOCAB, SUPPORTED_LABELS, SUPPORTED_LANGS, TOP_K, sql_hashed_sparse, sql_list, sql_vocab_match,
)
from revlens.session import load_table, scratch_path

EMB_DIM = 64
ANN_K, ANN_LISTS = 10, 32


def _centroid_questions(emb: DataFrame) -> DataFrame:
    """One question per label: the label's mean vector, filtered to that label
    when the label is supported (else NULL filter -> no matches)."""
    c = group_centroids(emb, "label", "embedding", out_col="query_vector")
    return c.select(
        F.col("label").alias("query_id"),
        "query_vector",
        F.when(F.col("label").isin(SUPPORTED_LABELS), F.col("label")).alias("filter_entity"),
    )


def _label_topk(spark: SparkSession, sf_dir: str, strategy: str = "expr") -> DataFrame:
    emb = load_table(spark, sf_dir, "embeddings")
    q = _centroid_questions(emb)
    return topk_cosine(
        emb, q, TOP_K, id_col="vec_id", vec_col="embedding", entity_col="label",
        q_id_col="query_id", q_vec_col="query_vector", q_entity_col="filter_entity", dim=EMB_DIM,
        strategy=strategy,
    )


def q_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _label_topk(spark, sf_dir)
    return m.select("query_id", F.col("rank").cast("int"), "vec_id", F.round("score", 6).alias("score"))


def q_filtered_topk_numpy(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _label_topk(spark, sf_dir, strategy="blocked")
    return m.select("query_id", F.col("rank").cast("int"), "vec_id", F.round("score", 6).alias("score"))


def q_no_filter_no_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = load_table(spark, sf_dir, "embeddings")
    q = _centroid_questions(emb)
    m = topk_cosine(
        emb, q, TOP_K, id_col="vec_id", vec_col="embedding", entity_col="label", dim=EMB_DIM,
    )
    res = attach_matches(q, m, dim=EMB_DIM)
    return res.select("query_id", "filter_entity", "n_matches", "status")


def q_bad_query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = load_table(spark, sf_dir, "embeddings")
    good = group_centroids(emb, "label", "embedding", out_col="query_vector")
    q = (
        good.select(F.col("label").alias("query_id"), "query_vector", F.col("label").alias("filter_entity"))
        .unionByName(good.select(
            (F.col("label") + 100).alias("query_id"),
            F.slice("query_vector", 1, EMB_DIM - 1).alias("query_vector"),
            F.col("label").alias("filter_entity"),
        ))
        .unionByName(good.select(
            (F.col("label") + 200).alias("query_id"),
            F.lit(None).cast("array<double>").alias("query_vector"),
            F.col("label").alias("filter_entity"),
        ))
    )
    m = topk_cosine(emb, q, TOP_K, id_col="vec_id", vec_col="embedding", entity_col="label", dim=EMB_DIM)
    return attach_matches(q, m, dim=EMB_DIM).select("query_id", "status", "n_matches")


def q_filtered_topk_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = load_table(spark, sf_dir, "embeddings").withColumn(
        "polarity", F.when(F.element_at("embedding", 1) >= 0, F.lit("pos")).otherwise(F.lit("neg"))
    )
    c = group_centroids(emb, ["label", "polarity"], "embedding", out_col="query_vector")
    q = c.select(
        (F.col("label") * 10 + F.when(F.col("polarity") == "pos", 1).otherwise(0)).alias("query_id"),
        "query_vector", F.col("label").alias("filter_entity"), F.col("polarity").alias("filter_polarity"),
    )
    m = topk_cosine(
        emb, q, TOP_K, id_col="vec_id", vec_col="embedding", entity_col="label",
        extra_filters=[("filter_polarity", "polarity")], dim=EMB_DIM,
    )
    return m.select("query_id", F.col("rank").cast("int"), "vec_id", F.round("score", 6).alias("score"))


def q_cosine_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revlens.functions.vectors import cosine

    emb = load_table(spark, sf_dir, "embeddings")
    a = emb.select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("a_vec"))
    b = emb.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("b_vec"))
    pairs = a.join(b, F.col("b_id") == F.col("a_id") + 1)
    return pairs.select("a_id", "b_id", F.round(cosine("a_vec", "b_vec"), 6).alias("score"))


def q_index_dim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = load_table(spark, sf_dir, "embeddings")
    return (
        emb.groupBy(F.size("embedding").alias("dim"))
        .agg(F.count(F.lit(1)).alias("n_vectors"))
        .withColumn("dim_ok", F.col("dim") == EMB_DIM)
    )


def q_hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    return hashed_sparse(docs, "doc_id", "text", DIM).select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


def q_embed_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    return hashed_with_rejects(docs, "doc_id", "text", F.size(words("text")) == 0, "no token", DIM)


def _text_answer(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    docs = load_table(spark, sf_dir, "documents")
    questions = load_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    cfg = AnswerConfig(vocab=LANG_VOCAB, supported=SUPPORTED_LANGS, k=TOP_K, dim=DIM)
    return answer_text_questions(
        docs, questions, doc_id_col="doc_id", doc_text_col="text", entity_col="lang",
        q_id_col="query_id", q_text_col="text", cfg=cfg,
    )


def q_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _text_answer(spark, sf_dir)["matches"]
    return m.select("query_id", F.col("rank").cast("int"), "doc_id", F.round("score", 6).alias("score"))


def q_prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revlens.operators.prompt import prompt_context

    m = _text_answer(spark, sf_dir)["matches"]
    return prompt_context(m, "query_id", "text", TOP_K).select(
        "query_id", F.col("n_context").cast("int").alias("n_context"), "context"
    )


def q_build_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_answer(spark, sf_dir)["prompts"]


def q_question_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _text_answer(spark, sf_dir)["questions"]
    return q.select("query_id", "mention", "filter_entity", "n_matches", "status")


def _own_label_questions(emb: DataFrame) -> DataFrame:
    """Every vector whose id is divisible by 100 asks for the nearest of its own label."""
    return emb.where(F.col("vec_id") % 100 == 0).select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("label").alias("filter_entity"))


def _ann(spark: SparkSession, sf_dir: str, exact: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    emb = load_table(spark, sf_dir, "embeddings")
    q = _own_label_questions(emb)
    index = clustered.build(emb, scratch_path(spark, "clusters"), id_col="vec_id", vec_col="embedding",
                            key_cols=["label"], dim=EMB_DIM, n_lists=ANN_LISTS)
    return emb, q, clustered.search(index, q, ANN_K, exact=exact, q_key_cols=["filter_entity"])


def q_ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, m = _ann(spark, sf_dir, True)
    return m.select("query_id", F.col("rank").cast("int"), "vec_id", F.round("score", 6).alias("score"))


def q_ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The approximate form against brute force over all rows: questions, rows to be found, and whether nine in ten were."""
    emb, q, m = _ann(spark, sf_dir, False)
    whole = topk_cosine(emb, q, ANN_K, id_col="vec_id", vec_col="embedding", entity_col="label", dim=EMB_DIM)
    hits = whole.join(m.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hits.agg(F.count_distinct("query_id").alias("n_queries"), F.count(F.lit(1)).alias("n_expected"),
                    (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("recall_ok"))


def q_pages_to_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed pages to answers in one run: records out of the HTML, cleaned, into an index of buckets, which the questions ask."""
    fields = [FieldSpec("title", "title"), FieldSpec("lang", "html", kind="attr:lang")]
    records = extract_records(load_table(spark, sf_dir, "pages"), "html", None, fields, keep=["page_id"])
    cleaned = records.select("page_id", "lang", py_strip("title").alias("title")).where("lang IS NOT NULL AND title <> ''")
    index = build_index(spark, cleaned, scratch_path(spark, "pages-index"), id_col="page_id", text_col="title", entity_col="lang", dim=DIM, buckets=16)
    questions = load_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    cfg = AnswerConfig(vocab=LANG_VOCAB, supported=SUPPORTED_LANGS, k=TOP_K, dim=DIM)
    out = answer_text_questions(cleaned, questions, doc_id_col="page_id", doc_text_col="title", entity_col="lang",
                                q_id_col="query_id", q_text_col="text", cfg=cfg, corpus_vectors=index)
    matches = match_arrays(out["matches"], "query_id", "page_id", ["title"])
    ids = F.array_join(F.transform("matches", lambda m: m["id"].cast("string")), ",")
    titles = F.array_join(F.transform("matches", lambda m: m["metadata"]["title"]), "\n")
    asked = out["questions"].select("query_id", "filter_entity", "status", "prompt").join(matches, "query_id", "left")
    return asked.select("query_id", "filter_entity", "status", "prompt", F.coalesce(ids, F.lit("")).alias("page_ids"), F.coalesce(titles, F.lit("")).alias("titles"))


def _counting_model():
    """A model of three numbers a text that fails on texts with an address, and gives short ones too few numbers."""

    def encode(texts: list[str]) -> list[list[float]]:
        if any("@" in t for t in texts):
            raise ValueError("address in the text")
        return [[len(t), t.count(" "), t.count("\n")][:3 if len(t) >= 40 else 2] for t in texts]

    return encode


def q_embed_model_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user model that fails: a batch with a bad row is retried row by row, only the bad rows are rejected."""
    docs = spread(load_table(spark, sf_dir, "documents").select("doc_id", "text").where("text IS NOT NULL"))
    out = embed_with(docs, "text", _counting_model, 3)
    numbers = [F.get("vector", i).cast("bigint").alias(n) for i, n in enumerate(("n_chars", "n_blanks", "n_breaks"))]
    return out.select("doc_id", F.when(F.col("embed_error").isNull(), "ok").otherwise("rejected").alias("status"), F.col("embed_error").alias("error"), *numbers)


def q_lsa_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's vector under a model fitted on all documents: its size and length."""
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    v = semantic.fit(docs, "text", DIM).embed(docs, "text").select("doc_id", "vector")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return v.select("doc_id", F.when(F.col("vector").isNotNull(), F.size("vector")).alias("n_dims"), F.round(norm, 4).alias("norm"))


QUERIES = {
    "embed_model_rejects": q_embed_model_rejects,
    "pages_to_answers": q_pages_to_answers,
    "lsa_embed": q_lsa_embed,
    "ann_topk": q_ann_topk,
    "ann_recall": q_ann_recall,
    "filtered_topk": q_filtered_topk,
    "filtered_topk_numpy": q_filtered_topk_numpy,
    "no_filter_no_match": q_no_filter_no_match,
    "bad_query_vector": q_bad_query_vector,
    "filtered_topk_two_keys": q_filtered_topk_two_keys,
    "cosine_score": q_cosine_score,
    "index_dim_check": q_index_dim_check,
    "hash_embed": q_hash_embed,
    "embed_rejects": q_embed_rejects,
    "text_search": q_text_search,
    "prompt_context": q_prompt_context,
    "build_prompt": q_build_prompt,
    "question_status": q_question_status,
}

# ---------------------------------------------------------------- oracles

_SUP_LABELS = sql_list(SUPPORTED_LABELS)
_SUP_LANGS = sql_list(SUPPORTED_LANGS)

_CENTROIDS = """
cent AS (
  SELECT label, list(x ORDER BY i) AS centroid
  FROM (SELECT label, i, avg(x) AS x
        FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(generate_series(1, len(embedding))) AS i
              FROM embeddings)
        GROUP BY label, i)
  GROUP BY label
)"""


def _cos(a: str, b: str) -> str:
    return (f"list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))")


_LABEL_TOPK = f"""
WITH {_CENTROIDS},
q AS (SELECT label AS query_id, centroid, CASE WHEN label IN ({_SUP_LABELS}) THEN label END AS filter_entity FROM cent),
s AS (SELECT q.query_id, e.vec_id, {_cos('q.centroid', 'e.embedding::DOUBLE[]')} AS score
      FROM q JOIN embeddings e ON e.label = q.filter_entity)
SELECT query_id, rank, vec_id, round(round(score, 10), 6) AS score
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, vec_id) AS INTEGER) AS rank FROM s)
WHERE rank <= {TOP_K}
"""

_NO_FILTER = f"""
WITH {_CENTROIDS},
q AS (SELECT label AS query_id, centroid, CASE WHEN label IN ({_SUP_LABELS}) THEN label END AS filter_entity FROM cent),
m AS (SELECT q.query_id, count(*) AS n
      FROM q JOIN embeddings e ON e.label = q.filter_entity GROUP BY q.query_id)
SELECT q.query_id, q.filter_entity, CAST(least(coalesce(m.n, 0), {TOP_K}) AS INTEGER) AS n_matches,
       CASE WHEN q.filter_entity IS NULL THEN 'no_filter' ELSE 'ok' END AS status
FROM q LEFT JOIN m USING (query_id)
"""

_BAD_VECTOR = f"""
WITH {_CENTROIDS},
q AS (
  SELECT label AS query_id, centroid AS v, label AS filter_entity FROM cent
  UNION ALL SELECT label + 100, centroid[1:{EMB_DIM - 1}], label FROM cent
  UNION ALL SELECT label + 200, NULL::DOUBLE[], label FROM cent
),
m AS (SELECT q.query_id, count(*) AS n FROM q JOIN embeddings e ON e.label = q.filter_entity
      WHERE len(q.v) = {EMB_DIM} GROUP BY q.query_id)
SELECT q.query_id,
       CASE WHEN q.v IS NULL OR len(q.v) <> {EMB_DIM} THEN 'retrieval_error' ELSE 'ok' END AS status,
       CAST(least(coalesce(m.n, 0), {TOP_K}) AS INTEGER) AS n_matches
FROM q LEFT JOIN m USING (query_id)
"""

_TWO_KEYS = f"""
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v,
                  CASE WHEN embedding[1] >= 0 THEN 'pos' ELSE 'neg' END AS polarity FROM embeddings),
cent AS (
  SELECT label, polarity, list(x ORDER BY i) AS centroid
  FROM (SELECT label, polarity, i, avg(x) AS x
        FROM (SELECT label, polarity, unnest(v) AS x, unnest(generate_series(1, len(v))) AS i FROM e)
        GROUP BY ALL)
  GROUP BY label, polarity
),
q AS (SELECT label * 10 + CASE WHEN polarity = 'pos' THEN 1 ELSE 0 END AS query_id, centroid, label, polarity FROM cent),
s AS (SELECT q.query_id, e.vec_id, {_cos('q.centroid', 'e.v')} AS score
      FROM q JOIN e ON e.label = q.label AND e.polarity = q.polarity)
SELECT query_id, rank, vec_id, round(round(score, 10), 6) AS score
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, vec_id) AS INTEGER) AS rank FROM s)
WHERE rank <= {TOP_K}
"""

_COSINE = f"""
SELECT a.vec_id AS a_id, b.vec_id AS b_id,
       round({_cos('a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]')}, 6) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
"""

_DIM_CHECK = f"""
SELECT dim, count(*) AS n_vectors, dim = {EMB_DIM} AS dim_ok
FROM (SELECT CAST(len(embedding) AS INTEGER) AS dim FROM embeddings) GROUP BY dim
"""

_HASH_EMBED = f"""
SELECT doc_id, bucket, round(weight, 6) AS weight FROM {sql_hashed_sparse('documents', 'doc_id', 'text')}
"""

_REJECTS = f"""
WITH nb AS (SELECT doc_id, count(*) AS n FROM {sql_hashed_sparse('documents', 'doc_id', 'text')} GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN nb.n IS NULL THEN 'rejected' ELSE 'ok' END AS status,
       CASE WHEN text IS NULL THEN 'missing text' WHEN nb.n IS NULL THEN 'no token' END AS error, nb.n AS n_buckets
FROM documents d LEFT JOIN nb USING (doc_id)
"""

_TEXT_BASE = f"""
WITH q0 AS (SELECT item_id AS query_id, text, {sql_vocab_match('text', LANG_VOCAB)} AS mention FROM benchmark),
q AS (SELECT *, CASE WHEN mention IN ({_SUP_LANGS}) THEN mention END AS filter_entity FROM q0),
qv AS {sql_hashed_sparse('(SELECT * FROM q WHERE filter_entity IS NOT NULL)', 'query_id', 'text')},
dv AS {sql_hashed_sparse('documents', 'doc_id', 'text')},
s AS (SELECT q.query_id, d.doc_id, sum(qv.weight * dv.weight) AS score
      FROM qv JOIN dv ON qv.bucket = dv.bucket
      JOIN q ON q.query_id = qv.query_id
      JOIN documents d ON d.doc_id = dv.doc_id AND d.lang = q.filter_entity
      GROUP BY ALL),
r AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, doc_id) AS INTEGER) AS rank
                     FROM s) WHERE rank <= {TOP_K}),
ctx AS (SELECT r.query_id, string_agg(d.text, chr(10) ORDER BY r.rank) AS context, CAST(count(*) AS INTEGER) AS n_context
        FROM r JOIN documents d USING (doc_id) GROUP BY r.query_id)
"""


def _prompt_sql(base: str = _TEXT_BASE, columns: str = "q.query_id, CAST(coalesce(ctx.n_context, 0) AS INTEGER) AS n_matches") -> str:
    from revlens.operators.prompt import GROUNDED_TEMPLATE, NO_MATCH_TEMPLATE
    from revlens.registry.common import sql_str

    def tpl(t: str, **cols: str) -> str:
        import re

        parts, pos = [], 0
        for m in re.finditer(r"\{(\w+)\}", t):
            if m.start() > pos:
                parts.append(sql_str(t[pos:m.start()]))
            parts.append(cols[m.group(1)])
            pos = m.end()
        if pos < len(t):
            parts.append(sql_str(t[pos:]))
        return "concat(" + ", ".join(parts) + ")"

    ents = sql_str(", ".join(SUPPORTED_LANGS))
    return base + f"""
SELECT {columns},
       CASE WHEN coalesce(ctx.n_context, 0) = 0 THEN {tpl(NO_MATCH_TEMPLATE, question='q.text', entities=ents)}
            ELSE {tpl(GROUNDED_TEMPLATE, question='q.text', context='ctx.context')} END AS prompt
FROM q LEFT JOIN ctx USING (query_id)
"""


def _pages_sql() -> str:
    from revlens.registry.common import sql_strip
    from revlens.registry.pages import _first

    records = f"""(SELECT page_id AS doc_id, {sql_strip(_first('title'))} AS text, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang
  FROM pages WHERE regexp_matches(html, '<html lang="'))"""
    base = _TEXT_BASE.replace("WITH q0", f"WITH records AS MATERIALIZED (SELECT * FROM {records} WHERE text <> ''),\nq0")
    base = base.replace("documents", "records").replace(
        "CAST(count(*) AS INTEGER) AS n_context", "CAST(count(*) AS INTEGER) AS n_context, string_agg(CAST(r.doc_id AS VARCHAR), ',' ORDER BY r.rank) AS ids")
    return _prompt_sql(base, """q.query_id, q.filter_entity, CASE WHEN q.filter_entity IS NULL THEN 'no_filter' ELSE 'ok' END AS status,
       coalesce(ctx.ids, '') AS page_ids, coalesce(ctx.context, '') AS titles""")


_OWN_LABEL = f"""
WITH s AS (
  SELECT q.vec_id AS query_id, e.vec_id, round({_cos("q.embedding::DOUBLE[]", "e.embedding::DOUBLE[]")}, 10) AS score
  FROM embeddings q JOIN embeddings e ON e.label = q.label WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""

ORACLES = {
    "embed_model_rejects": """
WITH e AS (SELECT doc_id, text, CASE WHEN contains(text, '@') THEN 'ValueError: address in the text' WHEN length(text) < 40 THEN 'vector size 2 != 3' END AS error
           FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN error IS NULL THEN 'ok' ELSE 'rejected' END AS status, error,
       CASE WHEN error IS NULL THEN length(text) END AS n_chars,
       CASE WHEN error IS NULL THEN length(text) - length(replace(text, ' ', '')) END AS n_blanks,
       CASE WHEN error IS NULL THEN length(text) - length(replace(text, chr(10), '')) END AS n_breaks
FROM e""",
    "pages_to_answers": _pages_sql(),
    "lsa_embed": f"""
SELECT doc_id, CASE WHEN w THEN {DIM} END AS n_dims, CASE WHEN w THEN 1.0 END AS norm
FROM (SELECT doc_id, coalesce(regexp_matches(lower(text), '[\\p{{L}}\\p{{N}}]'), FALSE) AS w FROM documents)""",
    "ann_topk": f"{_OWN_LABEL} SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= {ANN_K}",
    "ann_recall": f"{_OWN_LABEL} SELECT count(DISTINCT query_id) AS n_queries, count(*) AS n_expected, TRUE AS recall_ok FROM r WHERE rank <= {ANN_K}",
    "filtered_topk": _LABEL_TOPK,
    "filtered_topk_numpy": _LABEL_TOPK,
    "no_filter_no_match": _NO_FILTER,
    "bad_query_vector": _BAD_VECTOR,
    "filtered_topk_two_keys": _TWO_KEYS,
    "cosine_score": _COSINE,
    "index_dim_check": _DIM_CHECK,
    "hash_embed": _HASH_EMBED,
    "embed_rejects": _REJECTS,
    "text_search": _TEXT_BASE + "SELECT query_id, rank, doc_id, round(round(score, 10), 6) AS score FROM r",
    "prompt_context": _TEXT_BASE + "SELECT query_id, n_context, context FROM ctx",
    "build_prompt": _prompt_sql(),
    "question_status": _TEXT_BASE + """
SELECT q.query_id, q.mention, q.filter_entity, CAST(coalesce(ctx.n_context, 0) AS INTEGER) AS n_matches,
       CASE WHEN q.filter_entity IS NULL THEN 'no_filter' ELSE 'ok' END AS status
FROM q LEFT JOIN ctx USING (query_id)""",
}
