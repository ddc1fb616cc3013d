"""HTML extraction as a Spark job (H1-H6).

Pages are parsed in Python workers with ``mapInPandas`` (one Arrow batch of
pages at a time, the tree is dropped after each page) and come out as typed
rows; everything after that is DataFrame code.

* :func:`extract_records` - generic: records = elements matching a tag and
  attributes; fields = first matching descendant's text / an attribute /
  a count of matching descendants (H1, H2, H5, H6).
* :func:`extract_reviews` - review pages as field specs of the generic
  operator plus column expressions: flag/body split of the text block, the
  rating table as an array of (header, value, stars) from which the last row of
  each name wins (H1-H5).  A record whose layout is broken is kept with an
  ``_error`` message instead of failing the job (quarantine).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.functions.htmltree import Node, parse
from revlens.functions.text import split_flag_body
from revlens.operators.clean import OVERALL, RECORD_COLUMNS, STAR_COLUMNS, TEXT, VERIFICATION
from revlens.operators.joins import spread


@dataclass(frozen=True)
class FieldSpec:
    """``kind``: ``text`` (first match's text, NULL if none), ``count``
    (number of matches), ``attr:<name>`` (attribute of the first match),
    ``self`` (the record element's own text; ``tag`` is ignored), or ``rows``
    (an array with one struct of ``cells`` for each match).  ``within`` is a
    path of (tag, attributes) whose first matches are searched in turn; nothing
    matches below a missing one."""

    name: str
    tag: str | None
    attrs: dict = field(default_factory=dict)
    kind: str = "text"
    within: tuple = ()
    cells: tuple = ()

    def value(self, node: Node):
        if self.kind == "self":
            return node.text()
        for tag, attrs in self.within:
            node = node.find(tag, attrs) if node is not None else None
        if self.kind in ("count", "rows"):
            hits = node.find_all(self.tag, self.attrs) if node is not None else []
            return len(hits) if self.kind == "count" else [{c.name: c.value(h) for c in self.cells} for h in hits]
        hit = node.find(self.tag, self.attrs) if node is not None else None
        if hit is None:
            return None
        if self.kind == "text":
            return hit.text()
        if self.kind.startswith("attr:"):
            return hit.attrs.get(self.kind[5:])
        raise ValueError(f"unknown field kind {self.kind}")

    def spark_type(self):
        if self.kind == "rows":
            return T.ArrayType(T.StructType([T.StructField(c.name, c.spark_type()) for c in self.cells]))
        return T.IntegerType() if self.kind == "count" else T.StringType()


def _frame(items: list[dict], names: Sequence[str]) -> pd.DataFrame:
    """Columns as object arrays, so an all-missing text column stays None
    (pandas would turn it into float NaN, which Arrow will not read as text)."""
    return pd.DataFrame({n: pd.Series([it.get(n) for it in items], dtype=object) for n in names})


def _out_schema(df: DataFrame, keep: Sequence[str], fields: Sequence[FieldSpec], record_no: bool) -> T.StructType:
    cols = [df.schema[c] for c in keep]
    if record_no:
        cols.append(T.StructField("record_no", T.IntegerType()))
    cols += [T.StructField(f.name, f.spark_type()) for f in fields]
    cols.append(T.StructField("_error", T.StringType()))
    return T.StructType(cols)


def extract_records(
    df: DataFrame,
    html_col: str,
    record_tag: str | None,
    fields: Sequence[FieldSpec],
    keep: Sequence[str] = (),
    record_attrs: dict | None = None,
) -> DataFrame:
    """One row per record element (``record_no`` = position in the page).

    With ``record_tag=None`` the whole page is the single record (field
    fetch per page).  A page without records gives no rows.
    """
    fields = list(fields)
    keep = list(keep)
    per_page = record_tag is None
    schema = _out_schema(df, keep, fields, record_no=not per_page)

    def run(batches):
        for pdf in batches:
            out: list[dict] = []
            for rec in pdf.to_dict("records"):
                try:
                    root = parse(rec[html_col])
                except Exception as exc:  # noqa: BLE001 - quarantined per page
                    out.append({**{k: rec[k] for k in keep}, "_error": f"parse: {exc}"})
                    continue
                nodes = [root] if per_page else root.find_all(record_tag, record_attrs)
                for i, node in enumerate(nodes):
                    item = {k: rec[k] for k in keep}
                    if not per_page:
                        item["record_no"] = i
                    try:
                        for f in fields:
                            item[f.name] = f.value(node)
                        item["_error"] = None
                    except Exception as exc:  # noqa: BLE001 - quarantined per record
                        item["_error"] = f"{type(exc).__name__}: {exc}"
                    out.append(item)
            if out:
                yield _frame(out, [f.name for f in schema.fields])

    return spread(df.select(*keep, html_col)).mapInPandas(run, schema)


_BOX = ("div", {"class": "tc_mobile"})
_TABLE = ("table", {"class": "review-ratings"})
REVIEW_FIELDS = (
    FieldSpec(OVERALL, "span", {"itemprop": "ratingValue"}),
    FieldSpec("_block", "div", {"class": "text_content"}, within=(_BOX,)),
    FieldSpec("_tables", *_TABLE, kind="count", within=(_BOX,)),
    FieldSpec("_ratings", "tr", kind="rows", within=(_BOX, _TABLE), cells=(
        FieldSpec("header", "td", {"class": "review-rating-header"}),
        FieldSpec("value", "td", {"class": "review-value"}),
        FieldSpec("stars", "span", {"class": "star fill"}, kind="count"),
    )),
)
REVIEW_COLUMNS = RECORD_COLUMNS[1:]  # what a page gives: all but the entity


def extract_reviews(
    pages: DataFrame, html_col: str = "html", entity_col: str = "entity", keep: Sequence[str] = ("page_id",),
    record_tag: str = "article", record_attrs: dict | None = None,
) -> DataFrame:
    """Review records of review pages: ``keep, entity, record_no`` + the 16
    record fields as strings (the raw CSV layout) + ``_error``."""
    record_attrs = record_attrs if record_attrs is not None else {"itemprop": "review"}
    keep = [*keep, entity_col]
    raw = extract_records(pages, html_col, record_tag, REVIEW_FIELDS, keep, record_attrs)
    broken = (
        F.when(F.col("_error").isNotNull(), F.col("_error"))
        .when(F.col("_block").isNull(), F.lit("no text block"))
        .when(F.col("_tables") == 0, F.lit("no rating table"))
        .when(F.exists("_ratings", lambda r: r["header"].isNull()), F.lit("a rating row without header"))
    )
    flag, body = split_flag_body("_block")

    def rating(name: str) -> Column:
        named = F.filter("_ratings", lambda r: r["header"] == F.lit(name))
        last = F.try_element_at(named, F.lit(-1))
        return last["stars"].cast("string") if name in STAR_COLUMNS else last["value"]

    fields = {OVERALL: F.col(OVERALL), VERIFICATION: flag, TEXT: body}
    values = [F.when(F.col("_broken").isNull(), fields[c] if c in fields else rating(c)).alias(c) for c in REVIEW_COLUMNS]
    return raw.withColumn("_broken", broken).select(*keep, "record_no", *values, F.col("_broken").alias("_error"))
