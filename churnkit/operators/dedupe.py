"""Keep one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnkit.operators.joins import HotKeys, skew_join


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], hot: HotKeys | None = None) -> DataFrame:
    """The first row of each key by ``order`` (ascending, NULLs first).

    Same rows as ``row_number() over (partition by keys order by order) = 1``,
    in two phases, as most keys occur once:

    1. One hash aggregate counts the rows of each key (combined map-side, and of
       the key columns only).
    2. Rows of a key that occurs once pass as they are. Only rows of repeated keys
       are ordered. Each task first keeps the best row of each of its keys (the
       window's group limit), so of a key that holds a third of the table one row per
       task is shuffled.

    The rows meet the repeated keys in a join that AQE broadcasts by their
    measured size, or in ``skew_join`` with the keys ``hot`` names. Ties on
    ``order`` are broken by the remaining columns, so the result is fixed;
    rows equal in all of them are one. ``order`` entries are plain expressions
    compared ascending with NULLs first; negate numeric ones for descending.
    A NULL key is a key of its own.
    """
    cols = [c for c in df.columns if c not in keys]
    one = keys[0] if len(keys) == 1 else None
    many = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    if one and hot and hot.rows:
        # NULL keys never match in this join: they are told apart first
        named, unnamed = many.select(F.col("_k0").alias(one)).filter(F.col(one).isNotNull()), df.filter(F.col(one).isNull())
        known = df.filter(F.col(one).isNotNull())
        single = skew_join(known, named, one, "left_anti", hot)
        repeated = skew_join(known, named, one, "left_semi", hot).unionByName(unnamed)
    else:
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        single, repeated = df.join(many, same, "left_anti"), df.join(many, same, "left_semi")
    first = Window.partitionBy(*keys).orderBy(*[o.asc_nulls_first() for o in order], *[F.col(c).asc_nulls_first() for c in cols])
    best = repeated.withColumn("_place", F.row_number().over(first)).filter("_place = 1").drop("_place")
    return single.unionByName(best).select(*df.columns)
