"""Raw -> typed staging tables, and the customer-grain analysis base.

One chain of column expressions per table; the only shuffles are the
deduplication of customers (an aggregate by ``customer_id``), the
per-customer earliest valid join date (an aggregate), and the joins on
``customer_id`` that use them. Activity and products may hold many rows
for one customer, so they are joined with ``skew_join``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnkit import config as C
from churnkit.config import ChurnConfig
from churnkit.functions import (
    band,
    date_lit,
    day_diff,
    map_values,
    range_band,
    to_date,
    to_flag,
    to_float,
    to_int,
    to_int_via_float,
    year_diff,
)
from churnkit.functions.bands import zero_then_band
from churnkit.operators.dedupe import dedupe_first
from churnkit.operators.joins import HotKeys, skew_join

STAGING_CUSTOMER_COLUMNS = (
    "customer_id", "first_name", "last_name", "date_of_birth", "gender", "province", "branch_code",
    "join_date", "is_valid_join_date", "account_status", "monthly_income", "age", "age_band",
    "tenure_days", "tenure_band", "income_tier",
)

BASE_COLUMNS = (
    "customer_id", "province", "gender", "age", "age_band", "join_date", "tenure_days", "tenure_band",
    "monthly_income", "income_tier", "account_status", "is_valid_join_date", "churned", "churn_date",
    "avg_monthly_balance", "balance_tier", "credit_score", "credit_band", "num_transactions_3m",
    "is_active_member", "last_txn_date", "is_valid_last_txn", "is_outlier_balance",
)


#: Measures of the base with stored quantile sketches.
SKETCHED = ("monthly_income", "avg_monthly_balance", "credit_score")


def rate_keys() -> dict[str, Column]:
    """Keys of the rate queries over the base, and what they group."""
    txn = F.col("num_transactions_3m")
    plain = ("province", "gender", "age_band", "income_tier", "balance_tier", "credit_band", "is_active_member", "tenure_band")
    return {**{k: F.col(k) for k in plain},
            "txn_band": F.when(txn.isNotNull(), zero_then_band(txn, C.TXN_ZERO_LABEL, C.TXN_BANDS, C.TXN_TOP))}


def sketch_keys() -> dict[str, Column]:
    """Keys by which the quantile queries group or select; every combination has a sketch of each measure."""
    return {**{k: F.col(k) for k in ("income_tier", "balance_tier", "credit_band", "churned", "is_outlier_balance")},
            "income_known": F.col("monthly_income").isNotNull()}


def dedupe_customers(raw_customers: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """One raw row per customer id: the one with the lowest parsed income.

    An unparseable or missing income sorts first and wins. A NULL id is
    one group here and is dropped by the staging build.
    """
    return dedupe_first(raw_customers, ["customer_id"], [to_float("monthly_income")], hot)


def join_anchors(raw_customers: DataFrame, cfg: ChurnConfig) -> DataFrame:
    """Every raw customer id once, with two earliest join dates, in one pass.

    ``first_join_date``: earliest parseable date on or before the reference
    date (staging rules); ``first_join_any``: earliest parseable date
    (profiling rules). Either is NULL when the id has no such date. Taken
    over raw, not deduplicated, rows.
    """
    jd = to_date("join_date")
    valid = jd.isNotNull() & (jd <= date_lit(cfg.reference_date))
    return raw_customers.groupBy("customer_id").agg(
        F.min(F.when(valid, jd)).alias("first_join_date"),
        F.min(jd).alias("first_join_any"),
    )


def stage_customers(raw_customers: DataFrame, cfg: ChurnConfig, hot: HotKeys | None = None) -> DataFrame:
    ref = date_lit(cfg.reference_date)
    d = dedupe_customers(raw_customers, hot).filter(F.col("customer_id").isNotNull())
    jd = to_date("join_date")
    typed = d.select(
        "customer_id",
        "first_name",
        "last_name",
        to_date("date_of_birth").alias("date_of_birth"),
        map_values("gender", cfg.gender_variants, C.UNKNOWN).alias("gender"),
        map_values("province", cfg.province_variants, C.UNKNOWN).alias("province"),
        map_values("branch_code", {v: (k,) for k, v in cfg.branch_expansions.items()}, F.col("branch_code"))
        .alias("branch_code"),
        jd.alias("join_date"),
        F.when(jd.isNull(), F.lit(0)).when(jd > ref, F.lit(0)).otherwise(F.lit(1)).alias("is_valid_join_date"),
        F.coalesce(F.col("account_status"), F.lit(C.UNKNOWN)).alias("account_status"),
        to_int_via_float("monthly_income").alias("monthly_income"),
    )
    age = F.when(F.col("date_of_birth").isNotNull(), year_diff("date_of_birth", ref))
    tenure = F.when(F.col("is_valid_join_date") != 0, day_diff("join_date", ref))
    return typed.select(
        *typed.columns,
        age.alias("age"),
        range_band(age, C.AGE_RANGES, C.AGE_ABOVE, C.UNKNOWN, null_label=C.UNKNOWN).alias("age_band"),
        tenure.alias("tenure_days"),
        F.when(F.col("is_valid_join_date") == 0, F.lit(C.UNKNOWN))
        .otherwise(band(day_diff("join_date", ref), C.TENURE_BANDS, C.TENURE_TOP))
        .alias("tenure_band"),
        band("monthly_income", C.INCOME_TIERS, C.INCOME_TOP, null_label=C.UNKNOWN).alias("income_tier"),
    )


def stage_products(raw_products: DataFrame, raw_customers: DataFrame, cfg: ChurnConfig,
                   anchors: DataFrame | None = None, hot: HotKeys | None = None) -> DataFrame:
    """Clean product names, parse open dates, flag impossible ones, impute status.

    Raw products are kept as they are: no deduplication, no orphan filter.
    ``anchors`` (from ``join_anchors``) is computed from ``raw_customers``
    when not given.
    """
    od = to_date("open_date")
    first = (anchors if anchors is not None else join_anchors(raw_customers, cfg)).select(
        "customer_id", "first_join_date")
    p = skew_join(raw_products, first, "customer_id", "left", hot)
    valid = (
        F.when(od.isNull(), F.lit(0))
        .when(od < date_lit(cfg.inception_date), F.lit(0))
        .when(od < F.col("first_join_date"), F.lit(0))
        .otherwise(F.lit(1))
    )
    return p.select(
        "customer_id",
        map_values("product_name", cfg.product_variants, C.UNKNOWN).alias("product_name"),
        od.alias("open_date"),
        valid.alias("is_valid_open_date"),
        F.coalesce(F.col("product_status"), F.lit(C.UNKNOWN)).alias("product_status"),
    )


def stage_activity(raw_activity: DataFrame, raw_customers: DataFrame, cfg: ChurnConfig,
                   anchors: DataFrame | None = None, hot: HotKeys | None = None) -> DataFrame:
    """Typed activity of known customers, with bands and validity flags.

    Tiers use the unrounded balance; the stored balance is rounded to 2.
    A NULL balance falls to the top tier and is not an outlier.
    """
    bal = to_float("avg_monthly_balance")
    score_f = to_float("credit_score")
    score = to_int_via_float("credit_score")
    last = to_date("last_txn_date")
    first = (anchors if anchors is not None else join_anchors(raw_customers, cfg)).select(
        "customer_id", "first_join_date")
    # Inner join with one row per known id = EXISTS filter + date lookup.
    a = skew_join(raw_activity, first, "customer_id", "inner", hot)
    return a.select(
        "customer_id",
        F.round(bal, 2).alias("avg_monthly_balance"),
        F.when(bal > F.lit(cfg.outlier_balance), F.lit(1)).otherwise(F.lit(0)).alias("is_outlier_balance"),
        band(bal, C.BALANCE_TIERS, C.BALANCE_TOP).alias("balance_tier"),
        score.alias("credit_score"),
        F.when(score_f.isNull(), F.lit(C.UNKNOWN)).otherwise(band(score, C.CREDIT_BANDS, C.CREDIT_TOP)).alias("credit_band"),
        to_int("num_transactions_3m").alias("num_transactions_3m"),
        to_flag("is_active_member").alias("is_active_member"),
        last.alias("last_txn_date"),
        F.when(last.isNull(), F.lit(0)).when(last < F.col("first_join_date"), F.lit(0)).otherwise(F.lit(1))
        .alias("is_valid_last_txn"),
        to_flag("churned").alias("churned"),
        to_date("churn_date").alias("churn_date"),
    )


def analysis_base(customers: DataFrame, activity: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Customers joined to their activity: the base of every analysis query."""
    c = customers.select(*[x for x in BASE_COLUMNS if x in customers.columns])
    a = activity.select("customer_id", *[x for x in BASE_COLUMNS if x in activity.columns and x != "customer_id"])
    return skew_join(a, c, "customer_id", "inner", hot).select(*BASE_COLUMNS)

