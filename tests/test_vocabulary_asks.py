"""What the joined form sends as text, and that scratch shuffles go."""

from pyspark.sql import functions as F

from revlens.operators.vocabulary import _met, entries_of, match_vocabulary
from revlens.session import shuffles_dropped


def test_a_row_sends_its_best_entry(spark):
    texts = [(i, f"w{i} x{i} tail é w{i} x{i} y z", False) for i in range(300)] + [(None, "w1 x1 y z", False), (7, "w7", False), (8, "a b c a b", True), (9, "a b c", False)]
    vocab = spark.createDataFrame([(f"w{i} x{i}", i) for i in range(0, 300, 30)] + [("é w60 x60 y z", 5), ("a b", 1), ("b c", None)], "s string, v long")
    rows = spark.createDataFrame(texts, "_id0 int, line string, _several boolean").repartition(3)
    got = sorted(map(tuple, _met(rows, ["_id0"], [2, 5], entries_of(vocab, "s", "v")).collect()), key=str)
    want = [(i, f"w{i} x{i}", str(i), 1, 1) for i in range(0, 300, 30) if i != 60] + [(60, "é w60 x60 y z", "5", 4, 2), (8, "a b", "1", 1, 1), (8, "b c", None, 2, 1), (9, "a b", "1", 1, 2)]
    assert got == sorted(want, key=str)


def test_repeated_and_null_ids_and_long_entries(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "x b c a b"), (None, "b c"), (None, "c"), (2, "q"), (3, "a b c d e f g"), (4, "  "), (5, None)], "id int, text string")
    vocab = spark.createDataFrame([("A, b", "ab"), ("b c", "bc"), ("c", "c"), ("b c d e f g", "long")], "s string, v string")
    out = match_vocabulary(df, "id", "text", vocab, "s", "v", "joined").drop("text")
    one, none = (1, "ab", "a b", 3), (None, "bc", "b c", 2)
    want = [one, one, none, none, (2, None, None, 0), (3, "long", "b c d e f g", 4), (4, None, None, 0), (5, None, None, 0)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_a_setting_is_as_before(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with shuffles_dropped(spark):
        assert spark.conf.get(key) == "true"
        assert spark.range(100).groupBy((F.col("id") % 7).alias("k")).count().count() == 7
    assert spark.conf.get(key) == before
