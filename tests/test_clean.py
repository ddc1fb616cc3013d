"""CSV sink/source and cleaning."""

import datetime as dt

from pyspark.sql import functions as F

from revlens.operators.clean import clean_reviews
from revlens.operators.ordered import with_group_row_number, with_row_index
from revlens.operators.stats import file_stats
from revlens.session import scratch_path
from revlens.sources.csv import all_string_schema, read_csv_folder, write_entity_csv
from tests.fixtures import F2_FILE_A, F2_FILE_B, RAW_COLUMNS


def _raw(spark):
    return spark.createDataFrame(F2_FILE_A + F2_FILE_B, all_string_schema(RAW_COLUMNS))


def test_csv_round_trip_keeps_text(spark):
    path = scratch_path(spark, "t-csv")
    write_entity_csv(_raw(spark), "airline", path)
    back = read_csv_folder(spark, path, RAW_COLUMNS)
    got = {(r["source_file"], r["review_text"]) for r in back.collect()}
    assert ("ANA_reviews.csv", '  Great, "quoted"\nsecond line ') in got
    assert ("Air_Canada_reviews.csv", "meh") in got
    assert back.count() == len(F2_FILE_A) + len(F2_FILE_B)


def test_clean_rules(spark):
    path = scratch_path(spark, "t-clean")
    write_entity_csv(_raw(spark), "airline", path)
    cleaned = clean_reviews(read_csv_folder(spark, path, RAW_COLUMNS))
    rows = {r["review_text"]: r.asDict() for r in cleaned.collect()}
    assert "None" not in rows and len(rows) == 6  # text "None" is missing -> dropped
    great = rows['Great, "quoted"\nsecond line']
    assert great["overall_rating"] == 8.0 and great["verification"] == "Verified"
    assert great["Date Flown"] == dt.date(2024, 7, 1) and great["Recommended"] is True
    # per-file mean of the kept rows only (8, 6 -> 7), not counting the dropped row's 10
    assert rows["fine"]["overall_rating"] == 7.0 and rows[""]["overall_rating"] == 7.0
    assert rows["fine"]["verification"] == "Verified by X" and rows["fine"]["Date Flown"] is None
    assert rows["fine"]["Recommended"] is None and rows["fine"]["Aircraft"] == "Not specified"
    assert rows["fine"]["Route"] == "Not specified" and rows[""]["Date Flown"] == dt.date(2024, 7, 1)
    assert rows[""]["Recommended"] is False and rows[""]["Seat Comfort"] == 3.0  # imputed
    assert rows["ok"]["verification"] == "Not Verified" and rows["ok"]["overall_rating"] == 6.0
    # a file whose ratings are all missing keeps NULL
    assert rows["meh"]["overall_rating"] is None and rows["bad"]["Seat Comfort"] is None
    assert rows["ok"]["airline"] == "ANA"


def test_file_stats(spark):
    df = spark.createDataFrame(
        [("f1", 8.0, "Verified", "A"), ("f1", 6.0, "Not Verified", "A"), ("f1", 7.0, None, "Not specified"),
         ("f2", 1.0, None, "B")], "source_file string, rating double, verification string, route string")
    s = {r["source_file"]: r for r in file_stats(df, "source_file", "rating", "verification", "route",
                                                 with_total=True).collect()}
    assert s["f1"]["n_reviews"] == 3 and s["f1"]["n_routes"] == 2 and s["f1"]["n_verified"] == 1
    assert s["f2"]["n_verified"] == 0 and s[None]["n_reviews"] == 4 and abs(s["f1"]["avg_rating"] - 7.0) < 1e-12


def test_row_index_contiguous_under_skew(spark):
    # one key holds a third of all rows
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        (F.col("id") % 50).cast("string")).alias("k"), F.col("id"))
    ids = [r[0] for r in with_row_index(df, ["k", "id"], "rid", num_partitions=7).select("rid").collect()]
    assert sorted(ids) == list(range(3000))
    g = with_group_row_number(df, ["k"], ["id"], "rn", num_partitions=7)
    hot = sorted(r["rn"] for r in g.where("k = 'hot'").collect())
    assert hot == list(range(1000))
