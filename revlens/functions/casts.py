"""Guarded casts for dirty text.

Spark 4 runs with ANSI mode on, so a plain ``cast`` of bad text raises.  Each
cast here is guarded by a regex (so Spark and the SQL oracle agree on what is a
number) and then done with ``try_cast``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlens.functions.text import PY_SPACE_CLASS, _col, py_strip

INT_PATTERN = rf"\A{PY_SPACE_CLASS}*[+-]?[0-9]+{PY_SPACE_CLASS}*\z"
DOUBLE_PATTERN = (
    rf"\A{PY_SPACE_CLASS}*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?{PY_SPACE_CLASS}*\z"
)
MONTH_YEAR_PATTERN = r"\A\p{L}+ [0-9]{4}\z"


def safe_int(c) -> Column:
    """``int(x)`` or missing: optional sign, ASCII digits, surrounding blanks.

    Decimal text such as ``8.0`` is missing (it is not an integer literal).
    """
    c = _col(c)
    return F.when(c.rlike(INT_PATTERN), py_strip(c).try_cast("bigint"))


def safe_double(c) -> Column:
    """``to_numeric(errors='coerce')`` for plain decimal / scientific text."""
    c = _col(c)
    return F.when(c.rlike(DOUBLE_PATTERN), py_strip(c).try_cast("double"))


def month_year(c) -> Column:
    """Full month name + 4-digit year (``July 2024``, any case) -> first of month."""
    c = _col(c)
    return F.when(
        c.rlike(MONTH_YEAR_PATTERN),
        F.to_date(F.try_to_timestamp(F.initcap(c), F.lit("MMMM yyyy"))),
    )


def yes_no(c, yes: str = "yes", no: str = "no") -> Column:
    """Exactly ``yes`` -> true, exactly ``no`` -> false, anything else missing."""
    c = _col(c)
    return F.when(c == yes, F.lit(True)).when(c == no, F.lit(False))
