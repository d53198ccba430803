"""Banding of numeric columns into labelled ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from churnkit.functions.text import as_col


def band(c, limits: Sequence[tuple[float, str]], top_label: str, null_label: str | None = None) -> Column:
    """``value < limit`` bands tried in order, else ``top_label``.

    A NULL value matches no comparison and so falls to ``top_label`` unless
    ``null_label`` is given, in which case NULL is tested first.
    """
    c = as_col(c)
    out = F.when(c.isNull(), F.lit(null_label)) if null_label is not None else None
    for limit, label in limits:
        cond = c < F.lit(limit)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return F.lit(top_label) if out is None else out.otherwise(F.lit(top_label))


def zero_then_band(c, zero_label: str, limits: Sequence[tuple[float, str]], top_label: str) -> Column:
    """Exactly zero -> ``zero_label``, then ``value < limit`` bands, else ``top_label``.

    Negative values land in the first band.
    """
    c = as_col(c)
    return F.when(c == 0, F.lit(zero_label)).otherwise(band(c, limits, top_label))


def range_band(
    c,
    ranges: Sequence[tuple[int, int, str]],
    above: tuple[int, str] | None,
    else_label: str,
    null_label: str | None = None,
) -> Column:
    """Inclusive ``lo <= value <= hi`` bands, then ``value > limit``, else ``else_label``."""
    c = as_col(c)
    out = F.when(c.isNull(), F.lit(null_label)) if null_label is not None else None
    for lo, hi, label in ranges:
        cond = c.between(lo, hi)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    if above is not None:
        cond = c > F.lit(above[0])
        out = F.when(cond, F.lit(above[1])) if out is None else out.when(cond, F.lit(above[1]))
    return F.lit(else_label) if out is None else out.otherwise(F.lit(else_label))
