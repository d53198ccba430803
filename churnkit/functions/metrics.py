"""Ratio expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from churnkit.functions.text import as_col


def pct(part, whole, digits: int = 2) -> Column:
    """``round(part / whole * 100, digits)`` in floating point; NULL when ``whole`` is 0."""
    ratio = F.try_divide(as_col(part).cast("double"), as_col(whole).cast("double"))
    return F.round(ratio * F.lit(100.0), digits)
