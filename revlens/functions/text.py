"""Text column expressions (JVM-side, codegen friendly).

All patterns here are written so that the same string works in Java regex and
in RE2, which keeps the Spark operators and their SQL oracles in step.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() accepts, i.e. what
# str.strip() removes.  U+0009-U+000D, U+001C-U+0020, U+0085, U+00A0, U+1680,
# U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
PY_SPACE_CLASS = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
STRIP_PATTERN = rf"\A{PY_SPACE_CLASS}+|{PY_SPACE_CLASS}+\z"
PY_SPACE_CHARS = "".join(
    chr(c) for c in [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                     0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)

# The strings pandas' CSV reader turns into missing values by
# default (pandas >= 2).  Lower-case "na" is deliberately not one of them.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: drop leading/trailing Unicode white space.

    ``F.trim`` without a character set only removes the space character, so a
    leading newline or a no-break space would survive it; ``btrim`` with
    Python's white-space set does the job without a regex.
    """
    return F.btrim(_col(c), F.lit(PY_SPACE_CHARS))


def null_na_tokens(c, tokens=NA_TOKENS) -> Column:
    """Missing when the whole value is one of ``tokens`` (pandas read semantics)."""
    c = _col(c)
    return F.when(~c.isin(list(tokens)), c)


def replace_values(c, mapping: dict) -> Column:
    """Whole-value replacement; values outside ``mapping`` (and NULL) unchanged."""
    c = _col(c)
    if not mapping:
        return c
    expr = F.when(c == F.lit(next(iter(mapping))), F.lit(mapping[next(iter(mapping))]))
    for k, v in list(mapping.items())[1:]:
        expr = expr.when(c == F.lit(k), F.lit(v))
    return expr.otherwise(c)


def split_flag_body(c, sep: str = "|") -> tuple[Column, Column]:
    """Split on ``sep``: (flag, body).

    flag = stripped first piece only when there are exactly two pieces;
    body = stripped last piece.
    """
    pieces = F.split(_col(c), "\\" + sep if sep in r"\^$.|?*+()[]{}" else sep)
    flag = F.when(F.size(pieces) == 2, py_strip(F.element_at(pieces, 1)))
    body = py_strip(F.element_at(pieces, -1))
    return flag, body


def strip_code_fence(c, lang: str = "json") -> Column:
    """Clean a model response that may be wrapped in a code fence.

    Strip; if it starts with the ```lang fence keep the piece between the first
    and second occurrence of that fence; then if it ends with a bare fence drop
    that last fence.  A bare opening fence is left in place.
    """
    fence = "```" + lang
    s = py_strip(c)
    s = F.when(s.startswith(fence), F.element_at(F.split(s, "```" + lang), 2)).otherwise(s)
    return F.when(s.endswith("```"), F.regexp_replace(s, r"```\z", "")).otherwise(s)


def is_json_object_text(c) -> Column:
    """Guard for strict JSON-object parsing: braces at both ends, nothing around."""
    return _col(c).rlike(r"(?s)\A\s*\{.*\}\s*\z")


def words(c, lower: bool = True) -> Column:
    """Array of word tokens: split on runs of non letters/digits, empties dropped."""
    s = F.lower(_col(c)) if lower else _col(c)
    return F.filter(F.split(s, r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 0)


def file_name_for(entity) -> Column:
    """Per-entity file name: blanks become underscores, ``_reviews.csv`` appended."""
    return F.concat(F.regexp_replace(_col(entity), " ", "_"), F.lit("_reviews.csv"))
