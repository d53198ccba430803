"""Segment, distribution, time-series and concentration analyses.

All are aggregates over a customer-grain table. Grouped outputs have at
most one row per distinct key value; the windows used on them (share of
total, year-over-year change) run over those few aggregated rows, never
over customer rows. Whole-table orderings (deciles, percentiles) use the
distributed ordering helper.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnkit.functions.metrics import pct
from churnkit.functions.text import as_col
from churnkit.operators.ordering import ntile_sums, percentile_exact
from churnkit.session import materialize


def _flag_sum(flag: str) -> Column:
    return F.sum(F.col(flag).cast("int"))


def rate_by(
    df: DataFrame,
    keys: Sequence[str | Column] = (),
    flag: str = "churned",
    where: Column | None = None,
    names: Sequence[str] = ("total_customers", "churned", "retained", "churn_rate_pct"),
) -> DataFrame:
    """Customers, flagged, not flagged and flagged percentage per key.

    ``not flagged`` is ``count - sum(flag)``: a NULL flag counts as not
    flagged and stays in the denominator.
    """
    total, flagged, rest, rate = names
    if where is not None:
        df = df.filter(where)
    n = F.count(F.lit(1))
    s = _flag_sum(flag)
    aggs = [n.alias(total), s.alias(flagged), (n - s).alias(rest), pct(s, n).alias(rate)]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def rate_sets(df: DataFrame, keys: Mapping[str, Column], flag: str = "churned") -> DataFrame:
    """Rows and flagged rows by each of several keys, each key for itself, from one pass (grouping sets).

    One row per key and value: ``_set``, the key's name; the key's own column
    with the value (NULL is a value); ``_n`` and ``_flagged``. ``rate_of`` reads one key's rates.
    """
    rows = df.select(*[c.alias(k) for k, c in keys.items()], F.col(flag).cast("int").alias("_flag"))
    by = F.lit(None).cast("string")
    for k in keys:
        by = F.when(F.grouping(k) == 0, F.lit(k)).otherwise(by)
    return rows.groupingSets([[F.col(k)] for k in keys], *[F.col(k) for k in keys]).agg(
        by.alias("_set"), F.count(F.lit(1)).alias("_n"), F.sum("_flag").alias("_flagged"))


def rate_of(sets: DataFrame, key: str | None, by: str, where: Column | None = None,
            names: Sequence[str] = ("total_customers", "churned", "retained", "churn_rate_pct")) -> DataFrame:
    """``rate_by`` of ``key`` read from ``rate_sets``; with no key, over all rows (summed over the values of ``by``)."""
    total, flagged, rest, rate = names
    own = sets.filter(F.col("_set") == (key or by))
    if where is not None:
        own = own.filter(where)
    if key is None:
        own = own.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_n"), F.sum("_flagged").alias("_flagged"))
    n, s = F.col("_n"), F.col("_flagged")
    return own.select(*([key] if key else []), n.alias(total), s.alias(flagged), (n - s).alias(rest), pct(s, n).alias(rate))


def with_share(counts: DataFrame, count_name: str, pct_name: str) -> DataFrame:
    """Add each row's percentage of the column total.

    The aggregated rows are written once; the total, one number summed by a
    distributed job, and the result both read them. No step gathers all
    groups into one task, however many distinct keys there are.
    """
    counts = materialize(counts, "share-counts")
    total = counts.agg(F.sum(count_name)).first()[0]
    return counts.withColumn(pct_name, pct(F.col(count_name), F.lit(total)))


def share_of_total(
    df: DataFrame,
    keys: Sequence[str | Column],
    count_name: str,
    pct_name: str = "pct_of_total",
) -> DataFrame:
    """Rows per key and their percentage of all rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_name))
    return with_share(counts, count_name, pct_name)


def summary_by(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    digits: int,
    names: Mapping[str, str],
    where: Column | None = None,
    stable_input: bool = False,
    sketch: DataFrame | None = None,
) -> DataFrame:
    """Count, min, max, mean, sample stdev and exact median of ``value`` per key.

    ``names`` maps ``count, min, max, avg, stdev, median`` to output names.
    Rows with a NULL key are left out (they match no group). Statistics are
    rounded to ``digits``; NULL values are ignored by all but the count.
    """
    if where is not None:
        df = df.filter(where)
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    v = F.col(value).cast("double")
    stats = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(names["count"]),
        F.round(F.min(v), digits).alias(names["min"]),
        F.round(F.max(v), digits).alias(names["max"]),
        F.round(F.avg(v), digits).alias(names["avg"]),
        F.round(F.stddev_samp(v), digits).alias(names["stdev"]),
    )
    # both sides hold one row per group; AQE picks the join from their measured sizes
    medians = percentile_exact(df, value, 0.5, by=keys, name="_median", stable_input=stable_input, sketch=sketch)
    out = stats.join(medians, list(keys), "left")
    return out.withColumn(names["median"], F.round(F.col("_median"), digits)).drop("_median")


def counts_by(df: DataFrame, keys: Mapping[str, Column], name: str, where: Column | None = None) -> DataFrame:
    """Rows per value of derived keys (e.g. year, quarter, month of a date)."""
    if where is not None:
        df = df.filter(where)
    return df.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(F.count(F.lit(1)).alias(name))


def period_change(
    counts: DataFrame,
    period: str,
    value: str,
    prior_name: str,
    change_name: str,
    change_pct_name: str,
) -> DataFrame:
    """Previous period's value, the change and the change in percent.

    ``counts`` has one row per period (a handful of rows), so the ordered
    window over it is cheap.
    """
    prior = F.lag(value).over(Window.partitionBy(F.lit(0)).orderBy(period))
    return (
        counts.withColumn(prior_name, prior)
        .withColumn(change_name, F.col(value) - F.col(prior_name))
        .withColumn(change_pct_name, pct(F.col(change_name), F.col(prior_name)))
    )


def ntile_share(
    df: DataFrame,
    value: str,
    tiebreak: str,
    k: int,
    tile_name: str,
    count_name: str,
    total_name: str,
    pct_name: str,
    stable_input: bool = False,
    sketch: DataFrame | None = None,
) -> DataFrame:
    """Rows, rounded total and share of the grand total per ``k``-tile.

    Tiles are ``ntile(k)`` over ``value`` descending (NULLs last), ties
    broken by ``tiebreak``; only rows near a tile's edge are ordered.
    """
    sums = ntile_sums(df, value, tiebreak, k, tile_name, count_name, "_sum", stable_input=stable_input, sketch=sketch)
    grand = F.sum("_sum").over(Window.partitionBy(F.lit(0)))
    return sums.select(
        tile_name,
        count_name,
        F.round(F.col("_sum"), 0).alias(total_name),
        pct(F.col("_sum"), grand).alias(pct_name),
    )


def _scalar_percentile(df: DataFrame, value: str, p: float, stable_input: bool, sketch: DataFrame | None):
    row = percentile_exact(df, value, p, stable_input=stable_input, sketch=sketch).first()
    return None if row is None else row[0]


def skew_gap(df: DataFrame, measures: Sequence[tuple[str, int, str]], where: Column | None = None,
             stable_input: bool = False, sketches: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Mean, exact median and their gap for each measure, in one row.

    ``measures`` are ``(column, digits, suffix)``; output columns are
    ``mean_<suffix>``, ``median_<suffix>`` and ``<suffix>_mean_median_gap``,
    the gap being the difference of the two rounded values. Medians are
    single numbers computed with the distributed ordering helper.
    """
    if where is not None:
        df = df.filter(where)
    # all medians from one distributed sort of (measure, value) rows
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(column).alias("_measure"), F.col(column).cast("double").alias("_value"))
        for column, _, _ in measures])).alias("_s")).select("_s._measure", "_s._value")
    sketch = None
    for column, _, _ in measures if sketches else ():
        own = sketches[column].withColumn("_measure", F.lit(column))
        sketch = own if sketch is None else sketch.unionByName(own)
    medians = {r["_measure"]: r["_median"] for r in
               percentile_exact(stacked, "_value", 0.5, by=["_measure"], name="_median",
                                stable_input=stable_input, sketch=sketch).collect()}
    cols = []
    for column, digits, suffix in measures:
        median = medians.get(column)
        mean = F.round(F.avg(F.col(column).cast("double")), digits)
        med = F.round(F.lit(median).cast("double"), digits)
        cols += [mean.alias(f"mean_{suffix}"), med.alias(f"median_{suffix}"),
                 (mean - med).alias(f"{suffix}_mean_median_gap")]
    return df.agg(*cols)


def outlier_sensitivity(
    df: DataFrame,
    value: str,
    flag: str,
    p: float,
    labels: tuple[str, str],
    names: Sequence[str] = ("dataset", "customer_count", "mean_balance", "churn_rate_pct"),
    stable_input: bool = False,
    sketch: DataFrame | None = None,
) -> DataFrame:
    """Count, mean and flag rate with all rows, and with rows below the p-th percentile.

    Rows at or above the cut-off are dropped, and so are rows whose value is
    NULL (the comparison is unknown for them).
    """
    cut = _scalar_percentile(df, value, p, stable_input, sketch)
    label_col, count_name, mean_name, rate_name = names

    def summary(label: str, rows: Column) -> Column:
        n = F.count(F.when(rows, F.lit(1)))
        return F.struct(
            F.lit(label).alias(label_col),
            n.alias(count_name),
            F.round(F.avg(F.when(rows, F.col(value))), 2).alias(mean_name),
            pct(F.sum(F.when(rows, F.col(flag).cast("int"))), n).alias(rate_name),
        )

    # both rows come from one pass; a NULL cut-off keeps no row
    below = F.col(value) < F.lit(cut).cast("double")
    both = df.agg(F.array(summary(labels[0], F.lit(True)), summary(labels[1], below)).alias("_rows"))
    return both.select(F.explode("_rows").alias("_row")).select("_row.*")


def top_n(df: DataFrame, where: Column, order: Sequence[Column], n: int, columns: Sequence[str | Column]) -> DataFrame:
    """The first ``n`` rows by ``order`` among rows meeting ``where``.

    Planned as a per-task top-n followed by a merge of at most
    ``n x tasks`` rows, so no task sorts the whole table.
    """
    return df.filter(where).orderBy(*order).limit(n).select(*[as_col(c) for c in columns])
