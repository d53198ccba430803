"""Safe conversions of untyped text columns.

Raw tables hold every value as a string. A value that does not parse
becomes NULL instead of failing the job, as a forgiving load would do.
Spark runs with ANSI casts, so each conversion is a guarded ``try_cast``:
the regex guard keeps out forms Spark accepts but a plain decimal parser
would not (``NaN``, ``Infinity``, ``1.5d``, ``2f``, a bare year as a date).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from churnkit.functions.text import as_col

DECIMAL_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"
ZERO_PATTERN = r"^\s*[+-]?0+\s*$"
#: Year-first dates, which read the same everywhere: with dashes, slashes or nothing between, and perhaps a time of day.
DATE_PATTERN = (
    r"^(\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{8})"
    r"(?:[ T](?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d{1,7})?)?)?$"
)


def to_float(c) -> Column:
    """Decimal text -> double; anything else, or a value beyond the double range, -> NULL."""
    c = as_col(c)
    parsed = F.trim(c).try_cast("double")
    return F.when(c.rlike(DECIMAL_PATTERN) & (F.abs(parsed) != F.lit(float("inf"))), parsed)


def to_int_via_float(c) -> Column:
    """Decimal text -> double -> int, truncating toward zero.

    ``"518.0"`` parses as 518 here, where a direct integer parse gives NULL.
    Values outside the int range give NULL.
    """
    return to_float(c).try_cast("int")


def to_int(c) -> Column:
    """Integer text -> int. ``"12.0"`` is not an integer and gives NULL."""
    c = as_col(c)
    return F.when(c.rlike(INTEGER_PATTERN), F.trim(c).try_cast("int"))


def to_flag(c) -> Column:
    """Bit text -> 0/1 int: any integer (non-zero is 1), TRUE or FALSE; else NULL."""
    c = as_col(c)
    word = F.upper(F.trim(c))
    return (
        F.when(c.rlike(ZERO_PATTERN), F.lit(0))
        .when(c.rlike(INTEGER_PATTERN), F.lit(1))
        .when(word == "TRUE", F.lit(1))
        .when(word == "FALSE", F.lit(0))
    )


def to_date(c, formats: Sequence[str] = ()) -> Column:
    """Year-first text (``DATE_PATTERN``) -> date, dropping a time of day; other text or impossible dates -> NULL.

    Day-first and month-first texts are ambiguous, so they are read only in
    the ``formats`` (Spark datetime patterns, the first that fits) a caller names.
    """
    t = F.trim(as_col(c))
    day = F.regexp_extract(t, DATE_PATTERN, 1)
    parsed = F.regexp_replace(day, r"^(\d{4})[-/]?(\d{1,2})[-/]?(\d{1,2})$", "$1-$2-$3").try_cast("date")
    return F.coalesce(parsed, *(F.try_to_date(t, f) for f in formats)) if formats else parsed
