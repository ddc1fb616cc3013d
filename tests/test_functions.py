"""Scalar rules: strip, guarded casts, NA tokens, split, fences, JSON, vocab."""

from pyspark.sql import functions as F

from revlens.functions.casts import month_year, safe_double, safe_int, yes_no
from revlens.functions.text import NA_TOKENS, file_name_for, null_na_tokens, py_strip, split_flag_body
from revlens.operators.understand import parse_model_json, route_match, vocab_match


def _one(spark, values, expr_fn, schema="s string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(expr_fn(F.col("s"))).collect()]


def test_py_strip_matches_python(spark):
    vals = ["\n x  ", "\t　y ", "  ", "z", "\x1ca\x1f"]
    assert _one(spark, vals, py_strip) == [v.strip() for v in vals]


def test_safe_int(spark):
    vals = ["8", " 8 ", "+8", "-3", "8.5", "8.0", "na", "n/a", "", None, "1e3", "12abc"]
    assert _one(spark, vals, safe_int) == [8, 8, 8, -3, None, None, None, None, None, None, None, None]


def test_safe_double(spark):
    vals = ["4", " 4.5 ", ".5", "1e3", "-2E-1", "abc", "", None, "4.", "inf"]
    assert _one(spark, vals, safe_double) == [4.0, 4.5, 0.5, 1000.0, -0.2, None, None, None, 4.0, None]


def test_month_year(spark):
    import datetime as dt

    vals = ["July 2024", "july 2024", "Jul 2024", "2024-07-01", " July 2024", None]
    d = dt.date(2024, 7, 1)
    assert _one(spark, vals, month_year) == [d, d, None, None, None, None]


def test_yes_no(spark):
    assert _one(spark, ["yes", "no", "Yes", "", None], yes_no) == [True, False, None, None, None]


def test_na_tokens(spark):
    vals = ["NA", "N/A", "n/a", "null", "None", "", "na", "ANA", "x"]
    out = _one(spark, vals, lambda c: null_na_tokens(c, NA_TOKENS))
    assert out == [None, None, None, None, None, None, "na", "ANA", "x"]


def test_split_flag_body(spark):
    df = spark.createDataFrame([("✅ Trip Verified | Good",), ("Good",), ("A | B | C",), (" a |",)], "s string")
    flag, body = split_flag_body("s")
    assert [tuple(r) for r in df.select(flag, body).collect()] == [
        ("✅ Trip Verified", "Good"), (None, "Good"), (None, "C"), ("a", "")]


def test_file_name(spark):
    assert _one(spark, ["Air Canada", "ANA"], file_name_for) == ["Air_Canada_reviews.csv", "ANA_reviews.csv"]


def test_model_json_cases(spark):
    cases = [
        ('{"airline":"Emirates"}', "Emirates"),
        ('```json\n{"airline":"Emirates"}\n```', "Emirates"),
        ('```\n{"airline":"Emirates"}\n```', None),
        ("{'airline':'Emirates'}", None),
        ("not json", None),
        ('{"airline":"X"', None),
        ('{"airline":"X","airline":"Emirates"}', "Emirates"),
        ('{"airline":"emirates"}', "emirates"),
        ('{"seat_type":"Business Class"}', None),
    ]
    df = spark.createDataFrame(cases, "raw string, want string")
    parsed = df.select("want", parse_model_json(F.col("raw"), "airline string, seat_type string")["airline"].alias("got"))
    for r in parsed.collect():
        assert r["got"] == r["want"]


def test_vocab_match_longest_then_earliest(spark):
    vocab = ["red widget", "widget", ("blue", "Blue")]
    vals = ["a red widget", "widget red widget", "BLUE and red widget", "widgets", None]
    assert _one(spark, vals, lambda c: vocab_match(c, vocab)) == ["red widget", "red widget", "red widget", None, None]


def test_extract_with_model(spark):
    from revlens.operators.understand import extract_with_model

    def make_model():
        def gen(prompts):
            out = []
            for p in prompts:
                if "boom" in p:
                    raise RuntimeError("model down")
                if "Emirates" in p:
                    out.append('```json\n{"airline": "Emirates", "aspect": "food"}\n```')
                elif "Qantas" in p:
                    out.append('{"airline": "Qantas"}')
                else:
                    out.append("Sorry, no JSON here")
            return out
        return gen

    qs = spark.createDataFrame([(1, "food on Emirates?"), (2, "Qantas seats"), (3, "hello"), (4, "boom")],
                               "qid long, text string")
    res = extract_with_model(qs, "text", make_model, "airline string, aspect string",
                             "Extract fields as JSON from: {question}", supported=["Emirates", "ANA"],
                             field="airline")
    got = {r.qid: (r.params.airline if r.params else None, r.filter_entity, r.generate_error is not None)
           for r in res.collect()}
    assert got == {1: ("Emirates", "Emirates", False), 2: ("Qantas", None, False), 3: (None, None, False),
                   4: (None, None, True)}


def test_longest_match_wins_wherever_it_stands(spark):
    vocab = ["york", "new york", "york city hall", "paris"]
    texts = ["york or New York", "in new york city hall", "paris then york", "Paris, new york", "newyork"]
    assert _one(spark, texts, lambda c: vocab_match(c, vocab)) == ["new york", "york city hall", "paris", "new york", None]


def test_route(spark):
    texts = ["How is the flight from Doha  to New York?", "from A to B, please", "nothing", None, "fromage to go", "from here"]
    assert _one(spark, texts, route_match) == ["Doha to New York", "A to B", None, None, None, None]
