"""Driver query registry: Spark callables and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from revlens.registry import cleaning, pages, retrieval, streaming, transcript, understanding

_MODULES = [retrieval, cleaning, understanding, pages, transcript, streaming]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for m in _MODULES:
        out.update(m.ORACLES)
    return out
