"""HTML extraction (H1-H6, F1) and stop-at-first-failure (S3)."""

from pyspark.sql import functions as F

from revlens.functions.htmltree import parse
from revlens.operators.html import FieldSpec, extract_records, extract_reviews
from revlens.sources.pages import stop_at_first_failure
from tests.fixtures import PAGE_BROKEN, PAGE_EMPTY, PAGE_TWO


def _pages(spark):
    data = [(1, "Emirates", PAGE_TWO), (2, "Emirates", PAGE_BROKEN), (3, "Emirates", PAGE_EMPTY)]
    return spark.createDataFrame(data, "page_id long, entity string, html string")


def test_review_records(spark):
    out = {(r["page_id"], r["record_no"]): r.asDict() for r in extract_reviews(_pages(spark)).collect()}
    assert set(out) == {(1, 0), (1, 1), (2, 0), (2, 1), (2, 2)}  # empty page: no rows
    a = out[(1, 0)]
    assert a["overall_rating"] == "8" and a["verification"] == "✅ Trip Verified"
    assert a["review_text"] == "Good flight"
    assert a["Seat Comfort"] == "3" and a["Cabin Staff Service"] == "0"
    assert a["Food & Beverages"] is None and a["Recommended"] == "yes" and a["_error"] is None
    b = out[(1, 1)]
    assert b["overall_rating"] is None and b["verification"] is None and b["review_text"] == "Good"
    assert b["Route"] == "Y"  # repeated header: last wins
    assert b["Wifi & Connectivity"] == "0"  # star row without spans: 0, not NULL
    c = out[(2, 0)]
    assert c["verification"] is None and c["review_text"] == "C"
    assert out[(2, 1)]["_error"] and out[(2, 2)]["_error"]  # quarantined, others kept


def test_generic_records_and_counts(spark):
    pages = spark.createDataFrame(
        [(1, '<ul><li><a href="/a">A &amp; B</a><li>plain</ul><p>x<p>y<script>var t="</p>";</script>')],
        "page_id long, html string")
    recs = extract_records(pages, "html", "li", [FieldSpec("href", "a", kind="attr:href"), FieldSpec("t", "a"),
                                                  FieldSpec("own", None, kind="self")], keep=["page_id"]).collect()
    assert [(r["record_no"], r["href"], r["t"], r["own"]) for r in recs] == [
        (0, "/a", "A & B", "A & B"), (1, None, None, "plain")]
    counts = extract_records(pages, "html", None, [FieldSpec("n_p", "p", kind="count")], keep=["page_id"]).first()
    assert counts["n_p"] == 2


def test_tree_implied_end_tags():
    root = parse("<p><b>one<br><p>two</p><div class='a b'>z</div>")
    assert [p.text() for p in root.find_all("p")] == ["one", "two"]
    assert root.find("div", {"class": "b"}).text() == "z"


def test_stop_at_first_failure(spark):
    df = spark.createDataFrame(
        [("E", 1, True), ("E", 2, True), ("E", 3, True), ("E", 4, False), ("E", 5, True), ("Q", 1, True)],
        "entity string, page int, ok boolean")
    kept = stop_at_first_failure(df, ["entity"], ["page"], ~F.col("ok"))
    assert sorted((r.entity, r.page) for r in kept.collect()) == [("E", 1), ("E", 2), ("E", 3), ("Q", 1)]


def test_read_pages_from_folder(spark):
    import os

    from revlens.session import scratch_path
    from revlens.sources.pages import read_pages

    folder = scratch_path(spark, "t-pages")
    os.makedirs(folder.replace("file:", ""), exist_ok=True)
    for name, html in [("a.html", PAGE_TWO), ("b.html", PAGE_EMPTY)]:
        with open(os.path.join(folder.replace("file:", ""), name), "w", encoding="utf-8") as fh:
            fh.write(html)
    pages = read_pages(spark, folder, fmt="html").withColumn("entity", F.lit("Emirates"))
    assert pages.count() == 2
    assert extract_reviews(pages).count() == 2
    raw = read_pages(spark, folder, fmt="binary").withColumn("entity", F.lit("Emirates"))
    assert sorted(r.html for r in raw.collect()) == sorted([PAGE_TWO, PAGE_EMPTY])
