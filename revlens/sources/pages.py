"""Landed web pages.

The reference fetches pages over HTTP one by one.  Here pages are landed
first (any crawler) and read as a table; the page plan says which URLs belong
to which entity, and ``stop_at_first_failure`` reproduces the rule that an
entity's pages after its first failed page are not used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.operators.joins import with_group


def page_plan(seeds: DataFrame, entity_col: str, base_url_col: str, max_pages: int = 5) -> DataFrame:
    """Seeds x pages 1..max_pages -> ``entity, page, url`` (``{base}/page/{n}/``)."""
    return seeds.select(
        F.col(entity_col).alias("entity"),
        F.explode(F.sequence(F.lit(1), F.lit(max_pages))).alias("page"),
        F.col(base_url_col).alias("_base"),
    ).select("entity", "page", F.concat(F.col("_base"), F.lit("/page/"), F.col("page").cast("string"),
                                          F.lit("/")).alias("url"))


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet", charset: str = "UTF-8") -> DataFrame:
    """Read landed pages: a Parquet/ORC table of ``page_id, url, html``, a
    folder of HTML files (``fmt="html"``, one page per file, path as url), or
    raw files decoded with ``charset`` (``fmt="binary"``)."""
    if fmt in ("parquet", "orc"):
        return spark.read.format(fmt).load(path)
    if fmt == "binary":
        raw = spark.read.format("binaryFile").load(path)
        return raw.select(
            F.col("path").alias("url"), F.decode("content", charset).alias("html"),
            F.xxhash64("path").alias("page_id"),
        )
    files = spark.read.text(path, wholetext=True)
    return files.select(
        F.col("_metadata.file_path").alias("url"), F.col("value").alias("html")
    ).withColumn("page_id", F.xxhash64("url"))


def read_pages_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """The same pages as a stream (new files picked up as they land)."""
    return spark.readStream.schema(schema).parquet(path)


def stop_at_first_failure(
    df: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str], failed: Column
) -> DataFrame:
    """Keep the rows of each key strictly before its first failing row.

    The first failure per key is a partial aggregate (``min`` of the order
    struct over failing rows), joined back; no window, so a key holding a large
    share of the rows is not gathered in one task.  A NULL key is a key of its own.
    """
    key_cols, order_cols = list(key_cols), list(order_cols)
    pos = F.struct(*[F.col(c) for c in order_cols])
    first = df.where(failed).groupBy(*key_cols).agg(F.min(pos).alias("_first_fail"))
    joined = with_group(df, first, key_cols)
    return joined.where(F.col("_first_fail").isNull() | (pos < F.col("_first_fail"))).drop("_first_fail")
