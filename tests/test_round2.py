"""Inputs with NULLs, moved and repeated ids, absent pages and differing headers."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from revlens.operators.clean import impute_mean_by_group
from revlens.operators.retrieve import topk_cosine
from revlens.operators.stats import file_stats
from revlens.operators.transcript import fold_runs, response_status
from revlens.operators.understand import validate
from revlens.plans.answer import AnswerConfig, index_documents
from revlens.plans.build_index import build_index
from revlens.plans.collect_clean import collect
from revlens.session import scratch_path
from revlens.sources.csv import read_csv_folder, write_entity_csv, write_table
from revlens.sources.index import upsert
from revlens.streaming.answer_stream import answer_batch
from revlens.streaming.fold_stream import fold_numbers
from tests.fixtures import PAGE_TWO


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_ranged_equals_window_with_nulls(spark):
    data = [(1, 1, None, "a"), (1, 2, None, "b"), (1, 3, "ai", "c"), (None, 1, "ai", "d"), (None, 2, None, "e"), (1, 4, "end", "f"), (1, 5, None, "g")]
    df = spark.createDataFrame(data, "k long, s long, t string, x string")
    for make in (
        lambda how: fold_runs(df, ["k"], ["s"], "t", [F.count("*").alias("n"), F.min("x").alias("x")], strategy=how),
        lambda how: response_status(df, ["k"], ["s"], "t", "end", "fail", strategy=how),
    ):
        window, ranged = rows(make("window")), rows(make("ranged").select(make("window").columns))
        assert window == ranged
        assert len(window) >= 3


def test_validate_many_and_repeated_values(spark):
    df = spark.createDataFrame([("v7", 1), ("no", 2), (None, 3)], "v string, value int")
    many = [f"v{i}" for i in range(1500)]
    want = [("no", 2, None), ("v7", 1, "v7"), (None, 3, None)]
    assert rows(validate(df, "v", many)) == sorted(want, key=str)
    frame = spark.createDataFrame([(x,) for x in [*many, "v7", "v7", None]], "name string")
    assert rows(validate(df, "v", frame)) == sorted(want, key=str)


def test_null_group_gets_its_mean(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None), ("a", 3.0), ("a", None)], "g string, x double")
    assert rows(impute_mean_by_group(df, ["g"], ["x"])) == sorted([(None, 1.0), (None, 1.0), ("a", 3.0), ("a", 3.0)], key=str)
    assert {r.x for r in impute_mean_by_group(df, [], ["x"]).collect()} == {1.0, 2.0, 3.0}


def test_total_row_is_told_from_a_null_file(spark):
    df = spark.createDataFrame([(None, 1.0, "Verified", "r"), ("f", 3.0, "x", "r")], "f string, a double, v string, r string")
    got = {(r.f, r.is_total): r.n_reviews for r in file_stats(df, "f", "a", "v", "r", with_total=True).collect()}
    assert got == {(None, False): 1, ("f", False): 1, (None, True): 2}


@pytest.mark.parametrize("strategy", ["expr", "blocked"])
def test_nan_vectors_and_string_ids(spark, strategy):
    corpus = spark.createDataFrame([("n", [float("nan"), 1.0], "e"), ("a", [1.0, 0.0], "e"), ("b", [0.0, 1.0], "e"), ("z", [0.0, 0.0], "e")], "id string, vector array<double>, entity string")
    q = spark.createDataFrame([("q", [1.0, 1.0], "e"), ("r", [float("nan"), 1.0], "e")], "query_id string, query_vector array<double>, filter_entity string")
    got = topk_cosine(corpus, q, 5, strategy=strategy, dim=2)
    assert [(r.query_id, r.rank, r.id) for r in got.orderBy("rank").collect()] == [("q", 1, "a"), ("q", 2, "b")]
    none = topk_cosine(corpus, q.where("false"), 5, strategy=strategy, dim=2)
    assert dict(none.dtypes)["id"] == "string" and dict(none.dtypes)["query_id"] == "string" and none.count() == 0


def test_index_replaces_by_id_whatever_the_entity(spark):
    path = scratch_path(spark, "t-moved")
    how = dict(id_col="id", text_col="text", entity_col="ent", dim=8, seq_col="n")
    schema = "id long, text string, ent string, n int"
    build_index(spark, spark.createDataFrame([(1, "a", "x", 0), (2, "b", "y", 0), (2, "b2", "y", 1), (4, "d", "z", 0)], schema), path, **how)
    idx = build_index(spark, spark.createDataFrame([(1, "a2", "y", 0), (4, "d2", "z", 0), (4, "d3", "y", 1), (5, "e", "x", 0)], schema), path, **how)
    assert rows(idx.select("id", "text", "ent")) == [(1, "a2", "y"), (2, "b2", "y"), (4, "d3", "y"), (5, "e", "x")]


def test_index_with_a_user_embedder(spark):
    path = scratch_path(spark, "t-embedder")
    d = spark.createDataFrame([(1, "a", "x"), (2, "bb", "x"), (3, None, "x")], "id long, text string, ent string")
    sizes = lambda df, text, out: df.withColumn(out, F.when(F.col(text) == "bb", F.array(F.lit(1.0))).when(F.col(text).isNotNull(), F.array(F.lit(1.0), F.lit(2.0))))
    idx = build_index(spark, d, path, id_col="id", text_col="text", entity_col="ent", dim=2, embedder=sizes)
    assert rows(idx.select("id", "vector")) == [(1, [1.0, 2.0]), (3, None)]  # the wrong size is left out


def test_upsert_by_several_columns(spark):
    base = spark.createDataFrame([("a|b", "c", 1), ("a", "b|c", 2), (None, "x", 3)], "k string, w string, v int")
    new = spark.createDataFrame([("a|b", "c", 10), (None, "x", 30)], "k string, w string, v int")
    assert rows(upsert(base, new, ["k", "w"])) == sorted([("a|b", "c", 10), ("a", "b|c", 2), (None, "x", 30)], key=str)


def test_absent_page_ends_its_entity(spark):
    plan = spark.createDataFrame([("e", i, f"u{i}") for i in (1, 2, 3)], "entity string, page int, url string")
    pages = spark.createDataFrame([("u1", PAGE_TWO, True), ("u3", PAGE_TWO, True)], "url string, html string, ok boolean")
    good, bad = collect(pages, plan)
    assert {r.page for r in good.collect()} == {1} and bad.count() == 0


def test_fold_numbers_equal_a_plain_loop():
    import random

    rng = random.Random(1)
    for _ in range(300):
        types = [rng.choice(["user", "ai", "tool", "clear", None]) for _ in range(rng.randint(1, 12))]
        state = rng.choice([(None, -1, 0), ("ai", 3, 5), ("user", 0, 2), (None, 2, 1)])
        last, no, epoch = state
        want = []
        for t in types:
            if t == "clear":
                last, no, epoch = None, -1, epoch + 1
                want.append((epoch, -1))
                continue
            if t == "user" or t != last or no < 0:
                no += 1
            last = t
            want.append((epoch, no))
        epochs, numbers, new = fold_numbers(pd.Series(types, dtype=object), ("user",), "clear", *state)
        assert list(zip(epochs.tolist(), numbers.tolist())) == want
        assert (new[0] if new[0] == new[0] else None, new[1], new[2]) == (last, no, epoch)


def test_csv_columns_by_header_name(spark, tmp_path):
    (tmp_path / "A_reviews.csv").write_text('airline,review_text,extra\nA,"x, ""y""\nz",1\n', encoding="utf-8")
    (tmp_path / "B_reviews.csv").write_text("review_text,airline\ntext,B\n", encoding="utf-8")
    (tmp_path / "C_reviews.csv").write_text("\ufeffairline\nC\n", encoding="utf-8")
    got = read_csv_folder(spark, str(tmp_path), ["airline", "review_text"])
    assert rows(got) == [("A", 'x, "y"\nz', "A_reviews.csv"), ("B", "text", "B_reviews.csv"), ("C", None, "C_reviews.csv")]
    empty = tmp_path / "none"
    empty.mkdir()
    assert read_csv_folder(spark, str(empty), ["airline"]).collect() == []


def test_entity_csv_comes_back_by_partition(spark, tmp_path):
    df = spark.createDataFrame([("Air Canada", "a"), ("Qatar", None)], "airline string, review_text string")
    write_entity_csv(df, "airline", str(tmp_path / "out"))
    got = read_csv_folder(spark, str(tmp_path / "out"), ["review_text", "airline"])
    assert rows(got) == [("a", "Air Canada", "Air_Canada_reviews.csv"), (None, "Qatar", "Qatar_reviews.csv")]


def test_written_table_reads_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id long, t string")
    write_table(df, str(tmp_path / "t"))
    assert rows(spark.read.parquet(str(tmp_path / "t"))) == [(1, "a")]


def test_audit_rows_have_matches_status_and_apology(spark):
    docs = spark.createDataFrame([(1, "good seat", "x"), (2, "bad seat", "x"), (3, "else", "y")], "doc_id long, text string, entity string")
    asked = spark.createDataFrame([("a", "x seat"), ("b", "x boom"), ("c", "nothing"), ("d", "y unusable")], "query_id string, text string")

    def embedder(df, text, out):
        one = F.array(F.lit(1.0), F.when(F.col(text).contains("bad"), 0.5).otherwise(0.1))
        return df.withColumn(out, F.when(F.col(text).contains("unusable"), F.lit(None)).otherwise(one))

    def make_generator():
        def run(prompts):
            if any("boom" in p for p in prompts):
                raise RuntimeError("no")
            return ["fine" for _ in prompts]

        return run

    cfg = AnswerConfig(vocab=["x", "y"], supported=["x", "y"], k=2, dim=2, embedder=embedder)
    index = index_documents(docs, "doc_id", "text", "entity", cfg)
    out = answer_batch(asked, index, cfg, q_id_col="query_id", q_text_col="text", doc_id_col="doc_id", doc_text_col="text", entity_col="entity", make_generator=make_generator)
    got = {r.query_id: r for r in out.collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "ok", "b": "error", "c": "no_filter", "d": "retrieval_error"}
    assert got["b"].response == cfg.apology and got["a"].response == "fine"
    assert [(m.id, m.metadata.text) for m in got["a"].matches] == [(1, "good seat"), (2, "bad seat")] and got["c"].matches is None
    assert got["a"].matches[0].score >= got["a"].matches[1].score


def test_running_counts_over_many_ranges(spark):
    """Runs and keys that span ranges, single rows per range, ties of type across keys."""
    import random

    from revlens.operators.ordered import with_running_count

    rng = random.Random(3)
    data = [(rng.choice([1, 1, 1, 2, None]), i, rng.choice(["a", "a", "a", "b", None]), rng.random() < 0.1) for i in range(400)]
    df = spark.createDataFrame(data, "k int, s int, t string, f boolean").repartition(5)
    for change in ("t", None):
        want, state = [], {}
        for k, s, t, f in data:
            seen, last, count = state.get(k, (False, None, 0))
            count += f or (change is not None and (not seen or t != last))
            state[k] = (True, t, count)
            want.append((k, s, count))
        for n in (1, 7, 60, 400):
            got = with_running_count(df, ["k"], ["s"], F.col("f"), change, "c", n).select("k", "s", "c")
            assert rows(got) == sorted(want, key=str), (change, n)
    assert with_running_count(df.limit(0), ["k"], ["s"], F.col("f"), "t").count() == 0
