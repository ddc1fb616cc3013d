"""End-to-end plans on fixtures: collect -> clean -> stats; index -> answer."""

from pyspark.sql import functions as F

from revlens.plans.answer import AnswerConfig, answer_text_questions
from revlens.plans.collect_clean import clean_and_summarise, collect, to_raw_layout
from revlens.sources.pages import page_plan
from tests.fixtures import PAGE_BROKEN, PAGE_EMPTY, PAGE_TWO


def test_collect_clean(spark):
    seeds = spark.createDataFrame([("Emirates", "https://r.example/emirates"), ("ANA", "https://r.example/ana")],
                                  "name string, base string")
    plan = page_plan(seeds, "name", "base", max_pages=3)
    u = "https://r.example/{}/page/{}/"
    pages = spark.createDataFrame([
        (u.format("emirates", 1), PAGE_TWO, True), (u.format("emirates", 2), PAGE_BROKEN, False),
        (u.format("emirates", 3), PAGE_TWO, True),  # after the failed page: not used
        (u.format("ana", 1), PAGE_BROKEN, True), (u.format("ana", 2), PAGE_EMPTY, True),
    ], "url string, html string, ok boolean")
    good, bad = collect(pages, plan)
    assert good.count() == 3 and bad.count() == 2
    cleaned, stats = clean_and_summarise(to_raw_layout(good))
    assert sorted(r.row_id for r in cleaned.collect()) == [0, 1, 2]
    s = {r.source_file: r for r in stats.collect()}
    assert s[None].n_reviews == 3 and s["Emirates_reviews.csv"].n_reviews == 2
    assert s["Emirates_reviews.csv"].n_verified == 1 and s["ANA_reviews.csv"].avg_rating == 5.0


def test_answer_plan(spark):
    docs = spark.createDataFrame([
        (1, "the cat sat on the mat", "en"), (2, "the dog sat", "en"), (3, "le chat est la", "fr"),
        (4, "el gato", "es")], "doc_id long, text string, lang string")
    qs = spark.createDataFrame([(1, "where is the cat"), (2, "le chat"), (3, "el gato"), (4, "nothing here")],
                               "qid long, text string")
    cfg = AnswerConfig(vocab=[("the", "en"), ("le", "fr"), ("el", "es")], supported=["en", "fr"], k=2, dim=64)
    res = answer_text_questions(docs, qs, doc_id_col="doc_id", doc_text_col="text", entity_col="lang",
                                q_id_col="qid", q_text_col="text", cfg=cfg)
    st = {r.qid: (r.filter_entity, r.n_matches, r.status) for r in res["questions"].collect()}
    assert st == {1: ("en", 2, "ok"), 2: ("fr", 1, "ok"), 3: (None, 0, "no_filter"), 4: (None, 0, "no_filter")}
    top = res["matches"].where((F.col("qid") == 1) & (F.col("rank") == 1)).first()
    assert top.doc_id == 1
    prompts = {r.qid: r.prompt for r in res["prompts"].collect()}
    assert "the cat sat on the mat" in prompts[1] and "en, fr" in prompts[3]
