"""Data-quality checks over any DataFrame.

Each check returns a small DataFrame (one row, or one row per distinct
value). All are single-pass aggregates: map-side partial aggregation
first, so a hot value costs one partial row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnkit.functions.text import as_col, folded
from churnkit.operators.joins import HotKeys, skew_join

def row_count(df: DataFrame, name: str = "total_rows") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def row_counts(tables: Mapping[str, DataFrame], label: str = "table_name", name: str = "row_count") -> DataFrame:
    """One row per table: its label and row count (a union of global counts)."""
    parts = [df.agg(F.count(F.lit(1)).alias(name)).select(F.lit(t).alias(label), name) for t, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def null_profile(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """NULL count per column, as ``SUM(CASE WHEN c IS NULL THEN 1 ELSE 0 END)``.

    ``columns`` maps output name -> input column. Like that SUM, a count
    over zero rows is NULL.
    """
    return df.agg(
        *[F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).alias(out) for out, c in columns.items()]
    )


def count_where(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """``COUNT(CASE WHEN cond THEN 1 END)`` for each named condition, in one pass."""
    return df.agg(*[F.count(F.when(cond, F.lit(1))).alias(name) for name, cond in conditions.items()])


def range_check(df: DataFrame, value: Column, low, high, names: tuple[str, str] = ("below_minimum", "above_maximum"),
                where: Column | None = None) -> DataFrame:
    """Rows below ``low`` and rows above ``high`` (NULL is neither), in one pass."""
    if where is not None:
        df = df.filter(where)
    return count_where(df, {names[0]: value < low, names[1]: value > high})


def pair_check(df: DataFrame, flag: Column, date: Column, on: str = "1", off: str = "0",
               names: tuple[str, str, str, str] = ("churned_with_date", "not_churned_without_date",
                                                   "churned_missing_date", "not_churned_has_date")) -> DataFrame:
    """Consistency of a flag and the date it implies, as four counts.

    Flag on with a date and flag off without one are the consistent pairs;
    the other two are violations. All four are reported, so the result
    shows both the evidence and the exceptions.
    """
    return count_where(df, {
        names[0]: (flag == on) & date.isNotNull(),
        names[1]: (flag == off) & date.isNull(),
        names[2]: (flag == on) & date.isNull(),
        names[3]: (flag == off) & date.isNotNull(),
    })


def one_spelling(df: DataFrame, column: str, *aggs: Column, fold: bool = True) -> DataFrame:
    """``aggs`` per distinct value of ``column``; with ``fold``, per folded value, shown in its smallest spelling."""
    if not fold:
        return df.groupBy(column).agg(*aggs)
    groups = df.groupBy(folded(column).alias("_folded")).agg(F.min(column).alias(column), *aggs)
    return groups.drop("_folded")


def value_counts(df: DataFrame, column: str | Column, name: str = "count", alias: str | None = None, fold: bool = False) -> DataFrame:
    """Rows per distinct value (NULL is one value); ``fold``, for a named column: see ``one_spelling``."""
    if fold:
        return one_spelling(df, column, F.count(F.lit(1)).alias(name))
    c = as_col(column)
    if alias:
        c = c.alias(alias)
    return df.groupBy(c).agg(F.count(F.lit(1)).alias(name))


def duplicate_keys(df: DataFrame, keys: Sequence[str], name: str = "occurrence_count") -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).filter(F.col(name) > 1)


def orphans(child: DataFrame, parent: DataFrame, key: str, hot: HotKeys | None = None) -> DataFrame:
    """Child rows whose key has no parent row (a NULL key never matches).

    The parent side is reduced to its distinct keys first, so a parent key
    repeated many times is one row per task before the shuffle.
    """
    parent_keys = parent.select(key).distinct()
    return skew_join(child, parent_keys, key, "left_anti", hot)


Metric = tuple[str, str, str, Column]  # check id, severity, metric name, aggregate expression


def _log_rows(row: DataFrame, labels: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Turn a one-row frame of counts (columns in ``labels`` order) into log rows."""
    entries = [
        F.struct(F.lit(cid).alias("check_id"), F.lit(sev).alias("severity"), F.lit(metric).alias("metric"),
                 F.col(c).cast("long").alias("value"))
        for (cid, sev, metric), c in zip(labels, row.columns)
    ]
    return row.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")


def quality_log(
    scans: Sequence[tuple[DataFrame, Sequence[Metric]]] = (),
    frames: Sequence[tuple[str, str, DataFrame]] = (),
    known: DataFrame | None = None,
) -> DataFrame:
    """One table of findings: ``check_id, severity, metric, value``.

    ``scans`` pairs a table with aggregate metrics over it: all metrics of a
    table are computed in one pass (one scan per table, not one per check).
    ``frames`` are checks already computed as one-row frames of counts
    (joins, distinct counts); each column becomes a metric. ``known`` are rows
    that are there already (``known_metrics``).
    """
    parts = [] if known is None else [known]
    for df, metrics in scans:
        row = df.agg(*[expr.alias(f"_m{i}") for i, (_, _, _, expr) in enumerate(metrics)])
        parts.append(_log_rows(row, [(cid, sev, name) for cid, sev, name, _ in metrics]))
    for cid, sev, df in frames:
        parts.append(_log_rows(df, [(cid, sev, c) for c in df.columns]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def known_metrics(spark: SparkSession, rows: Sequence[tuple[str, str, str, int | None]]) -> DataFrame:
    """Log rows of counts that were observed while a table was loaded."""
    return spark.createDataFrame(list(rows), "check_id string, severity string, metric string, value long")


def known_row(spark: SparkSession, values: Mapping[str, int | None]) -> DataFrame:
    """One row of observed counts, a column each."""
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"`{n}` long" for n in values))


def distinct_count(df: DataFrame, column: str, name: str, fold: bool = False) -> DataFrame:
    """Number of distinct values of ``column`` (with ``fold``, of folded values), NULL counted as one value."""
    return df.groupBy(folded(column) if fold else F.col(column)).agg(F.lit(1).alias("_one")).agg(F.count(F.lit(1)).alias(name))


def before_anchor(
    child: DataFrame,
    child_date: Column,
    anchors: DataFrame,
    key: str,
    anchor_col: str,
    name: str,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Count child rows dated before their key's anchor date (inner join).

    ``anchors`` holds one row per key.
    """
    joined = skew_join(child.withColumn("_d", child_date), anchors, key, "inner", hot)
    return joined.filter(F.col("_d") < F.col(anchor_col)).agg(F.count(F.lit(1)).alias(name))
