"""Collect and clean (stages 1-2): landed review pages -> cleaned table.

    page plan (entity x page -> url)                       S1
    landed pages joined on url, keep pages before the
    entity's first failed page                              S2, S3
    review records per page (mapInPandas parser)            H1-H6
    per-entity raw CSV (optional, reference layout)         S4
    cleaning in the reference's order, per-file means       C1-C9, F3, S6
    contiguous row ids in (file, page, record) order        C10
    per-file statistics + total                             A1-A5

Shuffles: the pages/plan join (broadcast when the plan is small, it has one
row per entity x page), the per-file means, the statistics, and the ranged
numbering.  Records that do not fit the layout are returned separately
(quarantine) instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions.text import file_name_for
from revlens.operators.clean import RECORD_COLUMNS, CleanSpec, clean_reviews
from revlens.operators.html import REVIEW_COLUMNS, extract_reviews
from revlens.operators.ordered import with_row_index
from revlens.operators.stats import file_stats
from revlens.sources.pages import stop_at_first_failure


def collect(pages: DataFrame, plan: DataFrame, ok_col: str = "ok") -> tuple[DataFrame, DataFrame]:
    """(records, quarantine).  ``pages``: ``url, html, ok``; ``plan``: ``entity, page, url``.

    A planned page that did not land is a failed page."""
    joined = plan.join(pages, "url", "left").withColumn(ok_col, F.coalesce(F.col(ok_col), F.lit(False)))
    usable = stop_at_first_failure(joined, ["entity"], ["page"], ~F.col(ok_col)).where(F.col(ok_col))
    recs = extract_reviews(usable, "html", "entity", keep=("page",))
    good = recs.where(F.col("_error").isNull()).drop("_error")
    bad = recs.where(F.col("_error").isNotNull())
    return good, bad


def to_raw_layout(records: DataFrame, file_key: str = "source_file") -> DataFrame:
    """Records in the raw CSV column layout plus the file key and order keys."""
    return records.select(
        F.col("entity").alias("airline"), *[F.col(f"`{c}`") for c in REVIEW_COLUMNS],
        file_name_for("entity").alias(file_key), "page", "record_no",
    ).select(*[F.col(f"`{c}`") for c in RECORD_COLUMNS], file_key, "page", "record_no")


def clean_and_summarise(raw: DataFrame, spec: CleanSpec | None = None) -> tuple[DataFrame, DataFrame]:
    """(cleaned with ``row_id``, per-file statistics with the total row)."""
    spec = spec or CleanSpec()
    cleaned = clean_reviews(raw, spec)
    order = [spec.file_key] + [c for c in ("page", "record_no") if c in cleaned.columns]
    with_ids = with_row_index(cleaned, order, "row_id")
    stats = file_stats(with_ids, spec.file_key, spec.overall, spec.verification, "Route", with_total=True)
    return with_ids, stats
