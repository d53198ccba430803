"""Reporting model: product portfolio, wide table, star schema and its checks.

All joins are on ``customer_id``. The portfolio is aggregated to one row
per customer before it is joined (no fan-out). Surrogate keys are dense
row numbers over ``customer_id`` computed with the distributed ordering
helper, so no step holds the whole table in one task.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnkit.config import PRODUCT_STATUS_ACTIVE, PRODUCT_STATUS_CLOSED
from churnkit.functions.dates import (
    date_key,
    month_name,
    week_of_year_sunday,
    weekday_name,
    weekday_number,
    year_month,
)
from churnkit.functions.metrics import pct
from churnkit.functions.text import folded, map_values
from churnkit.operators.joins import HotKeys, skew_join
from churnkit.operators.ordering import rank_rows

CUSTOMER_ATTRIBUTES = (
    "customer_id", "first_name", "last_name", "date_of_birth", "age", "age_band", "gender", "province",
    "branch_code", "join_date", "is_valid_join_date", "account_status", "tenure_days", "tenure_band",
    "monthly_income", "income_tier",
)
PORTFOLIO_COUNTS = ("total_products", "active_products", "closed_products")
ACTIVITY_ATTRIBUTES = (
    "avg_monthly_balance", "balance_tier", "is_outlier_balance", "credit_score", "credit_band",
    "num_transactions_3m", "is_active_member", "last_txn_date", "is_valid_last_txn", "churned", "churn_date",
)


def holding_flag_name(product: str) -> str:
    """``Cheque Account`` -> ``has_cheque_account``."""
    return "has_" + product.lower().replace(" ", "_")


def portfolio(products: DataFrame, product_names: Sequence[str], fold: bool = False) -> DataFrame:
    """Per customer: products held, active, closed, and a 0/1 flag per product. ``fold``: see ``functions.text.folded``."""
    status = F.col("product_status")
    name = F.col("product_name")
    if fold:
        status = map_values("product_status", {s: (s.upper(),) for s in (PRODUCT_STATUS_ACTIVE, PRODUCT_STATUS_CLOSED)}, None, folded)
    return products.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count(F.when(status == PRODUCT_STATUS_ACTIVE, F.lit(1))).alias("active_products"),
        F.count(F.when(status == PRODUCT_STATUS_CLOSED, F.lit(1))).alias("closed_products"),
        *[F.max(F.when(name == p, F.lit(1)).otherwise(F.lit(0))).alias(holding_flag_name(p)) for p in product_names],
    )


def wide_table(customers: DataFrame, activity: DataFrame, holdings: DataFrame, product_names: Sequence[str],
               hot: HotKeys | None = None) -> DataFrame:
    """One row per customer (per activity row): attributes, portfolio, activity, churn dates.

    Customers without products are kept, with NULL portfolio columns.
    """
    flags = [holding_flag_name(p) for p in product_names]
    cd = F.col("churn_date")
    # customers and holdings have one row per customer (and share bucketing, so they merge
    # bucket by bucket: a broadcast would hold all holdings in every executor);
    # activity may hold many rows for one customer
    known = customers.join(holdings.hint("merge"), "customer_id", "left")
    joined = skew_join(activity, known, "customer_id", "inner", hot)
    return joined.select(
        *CUSTOMER_ATTRIBUTES,
        *PORTFOLIO_COUNTS,
        *flags,
        *ACTIVITY_ATTRIBUTES,
        F.year(cd).alias("churn_year"),
        F.month(cd).alias("churn_month"),
        year_month(cd).alias("churn_year_month"),
        month_name(cd).alias("churn_month_name"),
        F.quarter(cd).alias("churn_quarter"),
    )


def dim_customer(customers: DataFrame, stable_input: bool = False) -> DataFrame:
    """Customer dimension: ``customer_key`` = row number by ``customer_id``."""
    ranked = rank_rows(customers.select(*CUSTOMER_ATTRIBUTES), [F.col("customer_id").asc()],
                       name="customer_key", stable_input=stable_input)
    return ranked.select("customer_key", *CUSTOMER_ATTRIBUTES)


def dim_product(holdings: DataFrame, product_names: Sequence[str], stable_input: bool = False) -> DataFrame:
    """Product-holding dimension: ``product_key`` = row number by ``customer_id``."""
    cols = ["customer_id", *PORTFOLIO_COUNTS, *[holding_flag_name(p) for p in product_names]]
    ranked = rank_rows(holdings.select(*cols), [F.col("customer_id").asc()], name="product_key",
                       stable_input=stable_input)
    return ranked.select("product_key", *cols)


def date_dimension(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row per day from ``start`` to ``end`` inclusive.

    Days are generated by ``spark.range`` (split across tasks) rather than
    by recursion or one exploded array.
    """
    first = F.lit(start).cast("date")
    n_days = (dt.date.fromisoformat(end) - dt.date.fromisoformat(start)).days + 1
    days = spark.range(0, max(n_days, 0)).select(F.date_add(first, F.col("id").cast("int")).alias("d"))
    d = F.col("d")
    q = F.quarter(d)
    dow = weekday_number(d)
    return days.select(
        date_key(d).alias("date_key"),
        d.alias("full_date"),
        F.year(d).alias("year"),
        F.month(d).alias("month_number"),
        month_name(d).alias("month_name"),
        q.alias("quarter"),
        F.concat(F.lit("Q"), q.cast("string"), F.lit(" "), F.year(d).cast("string")).alias("quarter_label"),
        year_month(d).alias("year_month"),
        week_of_year_sunday(d).alias("week_number"),
        dow.alias("day_of_week_number"),
        weekday_name(d).alias("day_of_week_name"),
        F.dayofmonth(d).alias("day_of_month"),
        F.when(dow.isin(1, 7), F.lit(1)).otherwise(F.lit(0)).alias("is_weekend"),
        F.when(d == F.last_day(d), F.lit(1)).otherwise(F.lit(0)).alias("is_month_end"),
    )


FACT_COLUMNS = (
    "churn_fact_key", "customer_key", "product_key", "join_date_key", "churn_date_key", "customer_id",
    "avg_monthly_balance", "credit_score", "num_transactions_3m", "monthly_income", "tenure_days",
    "churned", "is_active_member", "is_outlier_balance", "is_valid_last_txn", "is_valid_join_date",
    "balance_tier", "credit_band", "income_tier", "tenure_band", "age_band",
)


def fact_churn(activity: DataFrame, customers_dim: DataFrame, products_dim: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Churn fact: one row per activity row with a customer and a product holding.

    ``churn_fact_key`` = row number by ``customer_id``, then by a hash of the
    row: the order rests on the content alone, so a task that is run again
    gives the same keys and no copy of the joined rows is needed. Rows
    equal in every column may take each other's number. Date keys are NULL
    for an invalid join date or a missing churn date. The customer
    dimension carries every customer attribute, so one join serves both
    the key and the attributes; the two dimensions merge bucket by bucket.
    """
    a = activity.select(
        "customer_id", "avg_monthly_balance", "credit_score", "num_transactions_3m", "churned",
        "is_active_member", "is_outlier_balance", "is_valid_last_txn", "balance_tier", "credit_band", "churn_date",
    )
    c = customers_dim.select(
        "customer_id", "customer_key", "join_date", "is_valid_join_date", "monthly_income", "tenure_days",
        "income_tier", "tenure_band", "age_band",
    )
    p = products_dim.select("customer_id", "product_key")
    joined = skew_join(a, c.join(p.hint("merge"), "customer_id"), "customer_id", hot=hot)
    rows = joined.select(
        "customer_key",
        "product_key",
        F.when(F.col("is_valid_join_date") == 1, date_key("join_date")).alias("join_date_key"),
        F.when(F.col("churn_date").isNotNull(), date_key("churn_date")).alias("churn_date_key"),
        "customer_id", "avg_monthly_balance", "credit_score", "num_transactions_3m", "monthly_income", "tenure_days",
        F.col("churned").cast("int").alias("churned"),
        F.col("is_active_member").cast("int").alias("is_active_member"),
        F.col("is_outlier_balance").cast("int").alias("is_outlier_balance"),
        F.col("is_valid_last_txn").cast("int").alias("is_valid_last_txn"),
        F.col("is_valid_join_date").cast("int").alias("is_valid_join_date"),
        "balance_tier", "credit_band", "income_tier", "tenure_band", "age_band",
    )
    content = F.xxhash64(*[F.col(c) for c in rows.columns])
    ranked = rank_rows(rows, [F.col("customer_id").asc(), content.asc()], name="churn_fact_key", unique_order=True)
    return ranked.select(*FACT_COLUMNS)


def calendar_use(fact: DataFrame, calendar: DataFrame) -> DataFrame:
    """Per day that a fact refers to: its calendar attributes, and the rows that joined and that churned on it.

    The fact's two date keys become one column in one pass, counted map-side;
    the calendar (days of the configured window, so of bounded size) is
    broadcast to the counted days. A day outside the window has NULL attributes.
    """
    uses = F.array(*[F.struct(F.col(f"{u}_date_key").alias("date_key"), F.lit(u).alias("_use")) for u in ("join", "churn")])
    days = fact.select(F.explode(uses).alias("_u")).select("_u.date_key", "_u._use").filter(F.col("date_key").isNotNull())
    counts = days.groupBy("date_key").agg(
        F.count(F.when(F.col("_use") == "join", F.lit(1))).alias("joined_rows"),
        F.count(F.when(F.col("_use") == "churn", F.lit(1))).alias("churned_rows"))
    return counts.join(F.broadcast(calendar), "date_key", "left").select(*calendar.columns, "joined_rows", "churned_rows")


def unmatched_keys(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, name: str,
                   skip_null: bool = False, small_dim: bool = False, hot: HotKeys | None = None) -> DataFrame:
    """Fact rows whose key has no dimension row (``NOT EXISTS``), counted.

    A NULL key never matches, so it counts as unmatched unless
    ``skip_null``. ``small_dim`` broadcasts a dimension of known bounded
    size (the calendar).
    """
    if skip_null:
        fact = fact.filter(F.col(fact_key).isNotNull())
    keys = dim.select(F.col(dim_key).alias(fact_key)).distinct()
    rows = fact.select(fact_key)
    if small_dim:
        missing = rows.join(F.broadcast(keys), fact_key, "left_anti")
    else:
        missing = skew_join(rows, keys, fact_key, "left_anti", hot)
    return missing.agg(F.count(F.lit(1)).alias(name))


def reconcile(sources: dict[str, DataFrame], flag: str = "churned") -> DataFrame:
    """Rows, flagged rows and flagged percentage from several routes to one number."""
    parts = []
    for label, df in sources.items():
        n = F.count(F.lit(1))
        s = F.sum(F.col(flag).cast("int"))
        parts.append(df.agg(F.lit(label).alias("source"), n.alias("total_customers"), s.alias("total_churned"),
                            pct(s, n).alias("churn_rate_pct")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
