"""Text normalisation and value mapping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalized(c) -> Column:
    """Upper case with leading and trailing spaces removed."""
    return F.upper(F.trim(as_col(c)))


def folded(c) -> Column:
    """The key under which text compares without regard to case and trailing spaces: equal keys, equal text."""
    return F.upper(F.rtrim(as_col(c)))


def map_values(c, variants: Mapping[str, Sequence[str]], default=None, key=normalized) -> Column:
    """Map normalised variants to a clean value; first matching entry wins.

    ``variants`` maps each clean value to the normalised spellings that mean
    it. Unmatched values (and NULL) get ``default``: a literal, or a Column
    (pass the input column to keep unmatched values as they are). ``key`` is
    how the input is normalised.
    """
    key = key(c)
    out = None
    for clean, spellings in variants.items():
        cond = key.isin(list(spellings))
        out = F.when(cond, F.lit(clean)) if out is None else out.when(cond, F.lit(clean))
    fallback = default if isinstance(default, Column) else F.lit(default)
    return fallback if out is None else out.otherwise(fallback)
