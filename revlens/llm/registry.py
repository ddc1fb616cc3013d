"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import bpe, decontaminate, divergence, jaccard, licenses, maxent, packing, quality, rotate, substring_dedup, suffix_dedup, vector_codes, warc
from revlens.llm.oracle import ORACLE  # noqa: F401
from revlens.session import load_table


def op1_maxent_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(load_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(load_table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(load_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(load_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs).drop("text")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(load_table(spark, sf_dir, "documents")).drop("node")


def op6_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.links(load_table(spark, sf_dir, "documents"))
    return out.withColumn("class_id", F.lower(F.hex("node"))).drop("node")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "benchmark"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(load_table(spark, sf_dir, "documents"))


def op9_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate.rotate(load_table(spark, sf_dir, "conversations"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(load_table(spark, sf_dir, "pages"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(load_table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(load_table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_maxent_score, op2_substring_dedup, op3_suffix_dedup, op4_quality, op5_license_scan, op6_jaccard_join, op6_jaccard_links, op7_decontaminate, op8_bpe, op9_perspective_rotation, op10_warc, op11_vector_codes, op12_source_divergence, op13_packing)}
