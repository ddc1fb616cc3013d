"""Cleaning of extracted review records.

The reference cleans one CSV per entity with pandas, in this order:
rating to int, verification replace, month-year date, seven ratings to
numbers, yes/no to boolean, category defaults; then drop rows missing the
entity or the text; then per-file mean imputation of the eight ratings; then
strip the text.  :func:`clean_reviews` keeps that order over one DataFrame of
all files, with ``source_file`` as the "file" key, so the means stay per file.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions.casts import month_year, safe_double, safe_int, yes_no
from revlens.functions.text import NA_TOKENS, null_na_tokens, py_strip, replace_values

# Column names of a review record as the reference writes them.
ENTITY = "airline"
OVERALL = "overall_rating"
VERIFICATION = "verification"
TEXT = "review_text"
STAR_COLUMNS = [
    "Seat Comfort", "Cabin Staff Service", "Food & Beverages", "Inflight Entertainment",
    "Ground Service", "Wifi & Connectivity", "Value For Money",
]
VALUE_COLUMNS = ["Aircraft", "Type Of Traveller", "Seat Type", "Route", "Date Flown", "Recommended"]
CATEGORY_COLUMNS = ["Aircraft", "Type Of Traveller", "Seat Type", "Route"]
DATE_COLUMN = "Date Flown"
BOOL_COLUMN = "Recommended"
RECORD_COLUMNS = [ENTITY, OVERALL, VERIFICATION, TEXT, *VALUE_COLUMNS[:5], *STAR_COLUMNS, BOOL_COLUMN]
VERIFICATION_MAP = {"✅ Trip Verified": "Verified", "Not Verified": "Not Verified"}
DEFAULT_CATEGORY = "Not specified"


@dataclass
class CleanSpec:
    entity: str = ENTITY
    overall: str = OVERALL
    verification: str = VERIFICATION
    text: str = TEXT
    stars: Sequence[str] = field(default_factory=lambda: list(STAR_COLUMNS))
    categories: Sequence[str] = field(default_factory=lambda: list(CATEGORY_COLUMNS))
    date: str | None = DATE_COLUMN
    boolean: str | None = BOOL_COLUMN
    verification_map: Mapping[str, str] = field(default_factory=lambda: dict(VERIFICATION_MAP))
    default_category: str = DEFAULT_CATEGORY
    file_key: str = "source_file"
    na_tokens: Sequence[str] = NA_TOKENS


def normalise_na(df: DataFrame, cols: Sequence[str] | None = None, tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """NA tokens -> NULL for string columns (what pandas does on CSV read).
    Columns of other types are left alone."""
    strings = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    cols = [c for c in (cols if cols is not None else strings) if c in strings]
    return df.select(*[null_na_tokens(c, tokens).alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns])


def cast_and_default(df: DataFrame, spec: CleanSpec) -> DataFrame:
    """Typed columns and category defaults (row-local, no shuffle)."""
    exprs = {
        spec.overall: safe_int(F.col(f"`{spec.overall}`")).cast("double"),
        spec.verification: replace_values(F.col(f"`{spec.verification}`"), dict(spec.verification_map)),
    }
    if spec.date:
        exprs[spec.date] = month_year(F.col(f"`{spec.date}`"))
    for c in spec.stars:
        exprs[c] = safe_double(F.col(f"`{c}`").cast("string"))
    if spec.boolean:
        exprs[spec.boolean] = yes_no(F.col(f"`{spec.boolean}`"))
    for c in spec.categories:
        exprs[c] = F.coalesce(F.col(f"`{c}`"), F.lit(spec.default_category))
    return df.select(*[exprs[c].alias(c) if c in exprs else F.col(f"`{c}`") for c in df.columns])


def drop_missing(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """drop rows with a NULL in any of ``subset``."""
    return df.dropna(subset=list(subset))


def impute_mean_by_group(df: DataFrame, group_cols: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """NULL -> mean of the non-NULL values of the same group.

    One aggregate for all columns (map-side partial, so a hot group is not
    gathered in one task), then a null-safe join of the per-group means, whose
    kind the planner picks from measured sizes.  Rows with a NULL group are a
    group of their own; a group whose values are all NULL keeps NULL.
    """
    keys = [F.col(f"`{c}`") for c in group_cols] or [F.lit(0)]  # no group column: one global group
    means = df.groupBy(*[k.alias(f"_key_{i}") for i, k in enumerate(keys)]).agg(
        *[F.avg(F.col(f"`{c}`")).alias(f"_mean_{i}") for i, c in enumerate(cols)])
    same = reduce(and_, (k.eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)))
    joined = df.join(means, same, "left")
    out = [
        F.coalesce(F.col(f"`{c}`"), F.col(f"_mean_{cols.index(c)}")).alias(c) if c in cols else F.col(f"`{c}`")
        for c in df.columns
    ]
    return joined.select(*out)


def clean_reviews(df: DataFrame, spec: CleanSpec | None = None) -> DataFrame:
    """Whole cleaning step on raw all-string records (one or many files)."""
    spec = spec or CleanSpec()
    df = normalise_na(df, [c for c in df.columns if c != spec.file_key], spec.na_tokens)
    df = cast_and_default(df, spec)
    df = drop_missing(df, [spec.entity, spec.text])
    df = impute_mean_by_group(df, [spec.file_key] if spec.file_key in df.columns else [], [*spec.stars, spec.overall])
    return df.withColumn(spec.text, F.coalesce(py_strip(F.col(f"`{spec.text}`")), F.lit("")))


def metadata_struct(df: DataFrame, fields: Mapping[str, str], out_col: str = "metadata") -> DataFrame:
    """pack renamed columns into one struct column (``target -> source``)."""
    return df.withColumn(out_col, F.struct(*[F.col(f"`{src}`").alias(dst) for dst, src in fields.items()]))
