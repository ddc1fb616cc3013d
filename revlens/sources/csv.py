"""Per-entity CSV sink and folder source.

Writing uses one directory per entity (``partitionBy``) named like the
reference's files (``Air_Canada_reviews.csv``).  Reading takes all columns as
strings by header name (no inference: pandas' whole-column guessing is replaced
by the typed cleaning step) and keeps the file key of every row.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.functions.text import file_name_for

CSV_OPTIONS = {
    "header": "true",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "emptyValue": "",
    "nullValue": "",
}


def all_string_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])


def write_entity_csv(df: DataFrame, entity_col: str, path: str, file_col: str = "source_file") -> None:
    """One CSV directory per entity, header row, entity kept in the data."""
    (
        df.withColumn(file_col, file_name_for(F.col(f"`{entity_col}`")))
        .write.mode("overwrite")
        .options(**CSV_OPTIONS)
        .partitionBy(file_col)
        .csv(path)
    )


def _files_by_header(spark: SparkSession, path: str, glob: str) -> dict[tuple[str, ...], list[str]]:
    """The folder's files grouped by their header (column names in order; a
    header is one line).  One row per file reaches the driver."""
    lines = spark.read.option("pathGlobFilter", glob).text(path)
    first = (
        lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
        .where("at = 0").withColumn("pos", F.monotonically_increasing_id())
        .groupBy("file").agg(F.min_by("value", "pos").alias("header"))
    )
    out: dict[tuple[str, ...], list[str]] = {}
    for r in first.collect():
        names = next(csv.reader([r.header.removeprefix("\ufeff")]), [])
        out.setdefault(tuple(names), []).append(r.file)
    return out


def read_csv_folder(
    spark: SparkSession, path: str, columns: Sequence[str], file_col: str = "source_file",
    glob: str = "*.csv",
) -> DataFrame:
    """Read a folder of CSVs as strings; columns are taken by header name, a
    missing one is NULL and further ones are left out (files may differ).

    Written by :func:`write_entity_csv`, the file key comes back as the
    partition column; for a flat folder of files it is the file name.
    """
    out = None
    for header, files in sorted(_files_by_header(spark, path, glob).items()):
        reader = spark.read.schema(all_string_schema(header)).options(**CSV_OPTIONS).option("basePath", path)
        df = reader.csv(files)
        key = F.col(file_col) if file_col in df.columns and file_col not in header else F.col("_metadata.file_name")
        have = [F.col(f"`{c}`") if c in header else F.lit(None).cast("string").alias(c) for c in columns if c != file_col]
        df = df.select(*have, key.alias(file_col))
        out = df if out is None else out.unionByName(df)
    if out is None:
        return spark.createDataFrame([], all_string_schema([*(c for c in columns if c != file_col), file_col]))
    return out


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Combined cleaned table, written to its own path (never the input folder)."""
    df.write.mode("overwrite").format(fmt).save(path)
