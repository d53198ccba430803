"""Every query of the reference pipeline as a named function of a warehouse.

Names are ``<step>_<number>_<short name>``: ``l`` load, ``dq`` profiling,
``st`` staging, ``v`` validation, ``eda`` analysis, ``w`` wide table,
``ss`` star schema.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnkit import config as C
from churnkit.functions import date_lit, month_name, to_date, to_float, to_int_via_float, year_month
from churnkit.functions.bands import zero_then_band
from churnkit.functions.metrics import pct
from churnkit.operators import model, quality, segments
from churnkit.operators.joins import skew_join
from churnkit.operators.ordering import merged_sketch, rank_rows
from churnkit.plans import staging
from churnkit.plans.profile import CHECKS
from churnkit.plans.warehouse import Warehouse

QUERIES: dict[str, Callable[[Warehouse], DataFrame]] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


def _counts_first(*names: str) -> dict[str, list[str]]:
    return {name: ["-count"] for name in names}


#: In what order a listing is read, ``-`` meaning descending. Queries return
#: their rows unordered (tables have no order); published reports are sorted.
LISTING_ORDER: dict[str, list[str]] = {
    "dq_03a_duplicate_ids": ["-occurrence_count"],
    "dq_03b_duplicate_rows": ["customer_id", "row_num"],
    **_counts_first("dq_04_gender_variants", "dq_05_province_variants", "dq_10_product_variants",
                    "v_02_province_counts", "v_03_gender_counts", "v_04_product_counts"),
    "ss_3_calendar_use": ["date_key"],
    "v_06_active_member_counts": ["is_active_member"],
    "v_07_churned_counts": ["churned"],
    "eda_02_rate_by_province": ["-churn_rate_pct"],
    "eda_03_rate_by_gender": ["-churn_rate_pct"],
    "eda_04_rate_by_age_band": ["age_band"],
    "eda_05_account_status_share": ["-total_customers"],
    "eda_06_new_customers_by_year": ["join_year"],
    "eda_07_income_summary": ["income_tier", "churned"],
    "eda_08_rate_by_income_tier": ["income_tier"],
    "eda_09_product_status_share": ["-total_products"],
    "eda_10_products_per_customer": ["product_count"],
    "eda_11_rate_by_product_count": ["product_count"],
    "eda_12_rate_by_product": ["-churn_rate_pct"],
    "eda_13_balance_summary": ["balance_tier", "churned"],
    "eda_14_rate_by_balance_tier": ["balance_tier"],
    "eda_15_credit_summary": ["credit_band", "churned"],
    "eda_16_rate_by_credit_band": ["credit_band"],
    "eda_17_rate_by_active_member": ["is_active_member"],
    "eda_18_rate_by_txn_band": ["txn_band"],
    "eda_19_rate_by_tenure_band": ["tenure_band"],
    "eda_21_monthly_churn": ["churn_month"],
    "eda_22_quarterly_churn": ["churn_year", "churn_quarter"],
    "eda_23_annual_churn_change": ["churn_year"],
    "eda_24_churn_by_month_of_year": ["churn_month_number"],
    "eda_26_balance_deciles": ["balance_decile"],
    "v_10_wide_by_churned": ["churned"],
    "v_11_wide_by_products": ["total_products"],
    "v_12_wide_by_province": ["-customer_count"],
}


def listing(wh: Warehouse, name: str) -> DataFrame:
    """A query's rows in the order of ``LISTING_ORDER`` (a distributed sort); NULL is the lowest value."""
    rows, order = QUERIES[name](wh), LISTING_ORDER.get(name)
    return rows.orderBy(*[F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in order]) if order else rows


# ---------------------------------------------------------------- load (S01)


@query("l_01_load_customers")
def load_customers(wh: Warehouse) -> DataFrame:
    return wh.raw("customers")


@query("l_02_load_products")
def load_products(wh: Warehouse) -> DataFrame:
    return wh.raw("products")


@query("l_03_load_activity")
def load_activity(wh: Warehouse) -> DataFrame:
    return wh.raw("activity")


@query("l_04_raw_row_counts")
def raw_row_counts(wh: Warehouse) -> DataFrame:
    counts = [(f"raw.{t}", wh.profile(t)[f"{check}.total_rows"]) for t, check in (("customers", "DQ-01"), ("products", "DQ-09"), ("activity", "DQ-14"))]
    return wh.spark.createDataFrame(counts, "table_name string, row_count long")


# ------------------------------------------------------------- profile (S02)


@query("dq_01_customer_rows")
def dq_customer_rows(wh: Warehouse) -> DataFrame:
    return _observed(wh, "customers", "DQ-01")


def _observed(wh: Warehouse, table: str, check: str) -> DataFrame:
    """A check's counts in one row, as they were observed while the table was loaded."""
    seen = wh.profile(table)
    return quality.known_row(wh.spark, {metric: seen[f"{check}.{metric}"] for metric in CHECKS[table][check]})


@query("dq_02_customer_nulls")
def dq_customer_nulls(wh: Warehouse) -> DataFrame:
    return _observed(wh, "customers", "DQ-02")


@query("dq_03a_duplicate_ids")
def dq_duplicate_ids(wh: Warehouse) -> DataFrame:
    return quality.duplicate_keys(wh.raw("customers"), ["customer_id"])


@query("dq_03b_duplicate_rows")
def dq_duplicate_rows(wh: Warehouse) -> DataFrame:
    """Every raw row of a duplicated id, numbered by parsed income (NULL first)."""
    raw = wh.raw("customers")
    dup_ids = quality.duplicate_keys(raw, ["customer_id"]).select("customer_id")
    rows = skew_join(raw, dup_ids, "customer_id", "left_semi", wh.raw_hot("customers")).withColumn("_income", to_float("monthly_income"))
    numbered = rank_rows(rows, [F.col("_income").asc_nulls_first()], by=["customer_id"], name="row_num")
    return numbered.select(*raw.columns, F.col("row_num"))


@query("dq_04_gender_variants")
def dq_gender_variants(wh: Warehouse) -> DataFrame:
    return quality.value_counts(wh.raw("customers"), "gender", fold=wh.cfg.fold_text)


@query("dq_05_province_variants")
def dq_province_variants(wh: Warehouse) -> DataFrame:
    return quality.value_counts(wh.raw("customers"), "province", fold=wh.cfg.fold_text)


@query("dq_06_future_join_dates")
def dq_future_join_dates(wh: Warehouse) -> DataFrame:
    return _observed(wh, "customers", "DQ-06")


@query("dq_07_income_validity")
def dq_income_validity(wh: Warehouse) -> DataFrame:
    return _observed(wh, "customers", "DQ-07")


@query("dq_08_null_account_status")
def dq_null_account_status(wh: Warehouse) -> DataFrame:
    return _observed(wh, "customers", "DQ-08")


@query("dq_09_product_rows")
def dq_product_rows(wh: Warehouse) -> DataFrame:
    return _observed(wh, "products", "DQ-09")


@query("dq_10_product_variants")
def dq_product_variants(wh: Warehouse) -> DataFrame:
    return quality.value_counts(wh.raw("products"), "product_name", fold=wh.cfg.fold_text)


@query("dq_11_null_product_status")
def dq_null_product_status(wh: Warehouse) -> DataFrame:
    return _observed(wh, "products", "DQ-11")


@query("dq_12_open_before_inception")
def dq_open_before_inception(wh: Warehouse) -> DataFrame:
    return _observed(wh, "products", "DQ-12")


def _earliest_join(wh: Warehouse) -> DataFrame:
    """Earliest parseable join date per id; future dates count (profiling form)."""
    return wh.join_anchors().select("customer_id", F.col("first_join_any").alias("first_join_date")).filter(
        F.col("first_join_date").isNotNull()
    )


@query("dq_13_open_before_join")
def dq_open_before_join(wh: Warehouse) -> DataFrame:
    return quality.before_anchor(wh.raw("products"), to_date("open_date"), _earliest_join(wh), "customer_id",
                                 "first_join_date", "open_before_join", wh.raw_hot("products"))


@query("dq_14_activity_rows")
def dq_activity_rows(wh: Warehouse) -> DataFrame:
    return _observed(wh, "activity", "DQ-14")


@query("dq_15_activity_nulls")
def dq_activity_nulls(wh: Warehouse) -> DataFrame:
    return _observed(wh, "activity", "DQ-15")


@query("dq_16_orphan_activity")
def dq_orphan_activity(wh: Warehouse) -> DataFrame:
    return quality.row_count(quality.orphans(wh.raw("activity"), wh.raw("customers"), "customer_id", wh.raw_hot("activity")),
                             "orphan_records")


@query("dq_17_txn_before_join")
def dq_txn_before_join(wh: Warehouse) -> DataFrame:
    return quality.before_anchor(wh.raw("activity"), to_date("last_txn_date"), _earliest_join(wh), "customer_id",
                                 "first_join_date", "txn_before_join", wh.raw_hot("activity"))


@query("dq_18_churn_date_integrity")
def dq_churn_date_integrity(wh: Warehouse) -> DataFrame:
    return _observed(wh, "activity", "DQ-18")


@query("dq_19_credit_score_range")
def dq_credit_score_range(wh: Warehouse) -> DataFrame:
    return _observed(wh, "activity", "DQ-19")


@query("dq_00_quality_log")
def dq_quality_log(wh: Warehouse) -> DataFrame:
    """Every profiling check as rows of ``check_id, severity, metric, value``.

    Counts of rows were observed while the tables were loaded; only duplicate
    ids, spelling variants (which contribute their number of rows) and the checks across
    tables read anything.
    """
    sev = C.CHECK_SEVERITY | {"L-04": C.MALFORMED_SEVERITY}
    customers, products = wh.raw("customers"), wh.raw("products")
    known = [(check, sev[check], metric, wh.profile(table)[f"{check}.{metric}"])
             for table, checks in CHECKS.items() for check, metrics in checks.items() for metric in metrics]
    frames = [
        ("DQ-03", sev["DQ-03"], quality.row_count(dq_duplicate_ids(wh), "duplicate_ids")),
        ("DQ-04", sev["DQ-04"], quality.distinct_count(customers, "gender", "gender_variants", wh.cfg.fold_text)),
        ("DQ-05", sev["DQ-05"], quality.distinct_count(customers, "province", "province_variants", wh.cfg.fold_text)),
        ("DQ-10", sev["DQ-10"], quality.distinct_count(products, "product_name", "product_name_variants", wh.cfg.fold_text)),
        ("DQ-13", sev["DQ-13"], dq_open_before_join(wh)),
        ("DQ-16", sev["DQ-16"], dq_orphan_activity(wh)),
        ("DQ-17", sev["DQ-17"], dq_txn_before_join(wh)),
    ]
    return quality.quality_log(frames=frames, known=quality.known_metrics(wh.spark, known))


# ------------------------------------------------------------- staging (S03)


@query("st_01_dedupe_customers")
def st_dedupe_customers(wh: Warehouse) -> DataFrame:
    return staging.dedupe_customers(wh.raw("customers"), wh.raw_hot("customers")).filter(F.col("customer_id").isNotNull())


@query("st_11_staging_customers")
def st_staging_customers(wh: Warehouse) -> DataFrame:
    return wh.staging_customers()


@query("st_14_staging_products")
def st_staging_products(wh: Warehouse) -> DataFrame:
    return wh.staging_products()


@query("st_20_staging_activity")
def st_staging_activity(wh: Warehouse) -> DataFrame:
    return wh.staging_activity()


@query("v_01_staging_row_counts")
def v_staging_row_counts(wh: Warehouse) -> DataFrame:
    return quality.row_counts({
        "staging.customers": wh.staging_customers(),
        "staging.products": wh.staging_products(),
        "staging.activity": wh.staging_activity(),
    })


@query("v_02_province_counts")
def v_province_counts(wh: Warehouse) -> DataFrame:
    return quality.value_counts(wh.staging_customers(), "province")


@query("v_03_gender_counts")
def v_gender_counts(wh: Warehouse) -> DataFrame:
    return quality.value_counts(wh.staging_customers(), "gender")


@query("v_04_product_counts")
def v_product_counts(wh: Warehouse) -> DataFrame:
    return quality.value_counts(wh.staging_products(), "product_name")


@query("v_05_duplicates_after_dedupe")
def v_duplicates_after_dedupe(wh: Warehouse) -> DataFrame:
    return quality.duplicate_keys(wh.staging_customers(), ["customer_id"])


@query("v_06_active_member_counts")
def v_active_member_counts(wh: Warehouse) -> DataFrame:
    return quality.value_counts(wh.staging_activity(), "is_active_member")


@query("v_07_churned_counts")
def v_churned_counts(wh: Warehouse) -> DataFrame:
    return quality.value_counts(wh.staging_activity(), "churned")


# ------------------------------------------------------------ analysis (S04)


@query("eda_00_base")
def eda_base(wh: Warehouse) -> DataFrame:
    return wh.base()


def _rate(wh: Warehouse, key: str, where: Column | None = None) -> DataFrame:
    """Churn rates by one key, read from the grouping sets that one pass over the base made."""
    return segments.rate_of(wh.rates(), key, key, where)


def _sketch(wh: Warehouse, value: str, by: tuple[str, ...] = (), where: Column | None = None) -> DataFrame:
    """The stored quantile sketches of the base merged for one query's groups and rows."""
    own = wh.quantiles() if where is None else wh.quantiles().filter(where)
    return merged_sketch(own, value, by)


@query("eda_01_overall_rate")
def eda_overall_rate(wh: Warehouse) -> DataFrame:
    return segments.rate_of(wh.rates(), None, "province",
                            names=("total_customers", "total_churned", "total_retained", "churn_rate_pct"))


@query("eda_02_rate_by_province")
def eda_rate_by_province(wh: Warehouse) -> DataFrame:
    return _rate(wh, "province")


@query("eda_03_rate_by_gender")
def eda_rate_by_gender(wh: Warehouse) -> DataFrame:
    return _rate(wh, "gender")


@query("eda_04_rate_by_age_band")
def eda_rate_by_age_band(wh: Warehouse) -> DataFrame:
    return _rate(wh, "age_band", F.col("age_band") != C.UNKNOWN)


@query("eda_05_account_status_share")
def eda_account_status_share(wh: Warehouse) -> DataFrame:
    counts = quality.value_counts(wh.base(), "account_status", "total_customers", fold=wh.cfg.fold_text)
    return segments.with_share(counts, "total_customers", "pct_of_total")


@query("eda_06_new_customers_by_year")
def eda_new_customers_by_year(wh: Warehouse) -> DataFrame:
    return segments.counts_by(wh.base(), {"join_year": F.year("join_date")}, "new_customers",
                              where=F.col("is_valid_join_date") == 1)


SUMMARY_NAMES = ("count", "min", "max", "avg", "stdev", "median")


def _summary_names(count_name: str, suffix: str) -> dict[str, str]:
    return {"count": count_name, **{k: f"{k}_{suffix}" for k in SUMMARY_NAMES[1:]}}


@query("eda_07_income_summary")
def eda_income_summary(wh: Warehouse) -> DataFrame:
    return segments.summary_by(
        wh.base(), ["income_tier", "churned"], "monthly_income", 0, _summary_names("customer_count", "income"),
        where=F.col("monthly_income").isNotNull() & (F.col("income_tier") != C.UNKNOWN), stable_input=True,
        sketch=_sketch(wh, "monthly_income", ("income_tier", "churned"), F.col("income_tier") != C.UNKNOWN),
    )


@query("eda_08_rate_by_income_tier")
def eda_rate_by_income_tier(wh: Warehouse) -> DataFrame:
    return _rate(wh, "income_tier", F.col("income_tier") != C.UNKNOWN)


def _product_counts(wh: Warehouse, keys: list[str]) -> DataFrame:
    """Products per customer (and ``keys``), counted before the join to the base."""
    return wh.staging_products().groupBy("customer_id", *keys).agg(F.count("product_name").alias("_n"))


@query("eda_09_product_status_share")
def eda_product_status_share(wh: Warehouse) -> DataFrame:
    per = _product_counts(wh, ["product_status"])
    joined = skew_join(wh.base().select("customer_id"), per, "customer_id", hot=wh.base_hot())
    counts = quality.one_spelling(joined, "product_status", F.sum("_n").alias("total_products"), fold=wh.cfg.fold_text)
    return segments.with_share(counts, "total_products", "pct_of_total")


def _products_per_customer(wh: Warehouse, keys: list[str]) -> DataFrame:
    joined = skew_join(wh.base().select("customer_id", *keys), _product_counts(wh, []), "customer_id",
                       hot=wh.base_hot())
    return joined.groupBy("customer_id", *keys).agg(F.sum("_n").alias("product_count"))


@query("eda_10_products_per_customer")
def eda_products_per_customer(wh: Warehouse) -> DataFrame:
    return segments.share_of_total(_products_per_customer(wh, []), ["product_count"], "customer_count",
                                   "pct_of_customers")


@query("eda_11_rate_by_product_count")
def eda_rate_by_product_count(wh: Warehouse) -> DataFrame:
    return segments.rate_by(_products_per_customer(wh, ["churned"]), ["product_count"])


@query("eda_12_rate_by_product")
def eda_rate_by_product(wh: Warehouse) -> DataFrame:
    """Distinct customers per product, and distinct churned ones.

    Both sides are reduced to one row per customer first (the set of products
    held, bounded by the number of product names; whether any row churned), so
    they meet partitioned by customer, and the exploded pairs are distinct.
    """
    held = wh.staging_products().groupBy("customer_id").agg(F.collect_set("product_name").alias("_names"))
    churn = wh.base().groupBy("customer_id").agg(
        F.max(F.when(F.col("churned") == 1, F.lit(1)).otherwise(F.lit(0))).alias("_churned"))
    pairs = held.join(churn, "customer_id").select(F.explode("_names").alias("product_name"), "_churned")
    per = pairs.groupBy("product_name").agg(
        F.count(F.lit(1)).alias("total_customers"), F.sum("_churned").cast("long").alias("churned_customers"))
    return per.withColumn("churn_rate_pct", pct(F.col("churned_customers"), F.col("total_customers")))


@query("eda_13_balance_summary")
def eda_balance_summary(wh: Warehouse) -> DataFrame:
    return segments.summary_by(wh.base(), ["balance_tier", "churned"], "avg_monthly_balance", 2,
                               _summary_names("customer_count", "balance"), stable_input=True,
                               sketch=_sketch(wh, "avg_monthly_balance", ("balance_tier", "churned")))


@query("eda_14_rate_by_balance_tier")
def eda_rate_by_balance_tier(wh: Warehouse) -> DataFrame:
    return _rate(wh, "balance_tier")


@query("eda_15_credit_summary")
def eda_credit_summary(wh: Warehouse) -> DataFrame:
    return segments.summary_by(
        wh.base(), ["credit_band", "churned"], "credit_score", 0, _summary_names("customer_count", "score"),
        where=F.col("credit_score").isNotNull() & (F.col("credit_band") != C.UNKNOWN), stable_input=True,
        sketch=_sketch(wh, "credit_score", ("credit_band", "churned"), F.col("credit_band") != C.UNKNOWN),
    )


@query("eda_16_rate_by_credit_band")
def eda_rate_by_credit_band(wh: Warehouse) -> DataFrame:
    return _rate(wh, "credit_band", F.col("credit_band") != C.UNKNOWN)


@query("eda_17_rate_by_active_member")
def eda_rate_by_active_member(wh: Warehouse) -> DataFrame:
    return _rate(wh, "is_active_member")


@query("eda_18_rate_by_txn_band")
def eda_rate_by_txn_band(wh: Warehouse) -> DataFrame:
    return _rate(wh, "txn_band", F.col("txn_band").isNotNull())


@query("eda_19_rate_by_tenure_band")
def eda_rate_by_tenure_band(wh: Warehouse) -> DataFrame:
    return _rate(wh, "tenure_band", F.col("tenure_band") != C.UNKNOWN)


@query("eda_20_top_at_risk")
def eda_top_at_risk(wh: Warehouse) -> DataFrame:
    b = F.col("avg_monthly_balance")
    where = (
        (F.col("churned") == 0) & (b > C.AT_RISK_MIN_BALANCE) & (F.col("is_active_member") == 0)
        & (F.col("num_transactions_3m") < C.AT_RISK_MAX_TXN) & (F.col("is_outlier_balance") == 0)
    )
    return segments.top_n(
        wh.base(), where, [b.desc(), F.col("customer_id").asc()], C.AT_RISK_LIMIT,
        ["customer_id", "province", "age", F.round(b, 0).alias("avg_balance"), "num_transactions_3m",
         "is_active_member", "credit_band", "tenure_days", "income_tier"],
    )


def _churned_rows(wh: Warehouse) -> DataFrame:
    return wh.base().filter(F.col("churn_date").isNotNull())


@query("eda_21_monthly_churn")
def eda_monthly_churn(wh: Warehouse) -> DataFrame:
    return segments.counts_by(_churned_rows(wh), {"churn_month": year_month("churn_date")}, "churned_customers")


@query("eda_22_quarterly_churn")
def eda_quarterly_churn(wh: Warehouse) -> DataFrame:
    return segments.counts_by(_churned_rows(wh), {"churn_year": F.year("churn_date"),
                                                  "churn_quarter": F.quarter("churn_date")}, "churned_customers")


@query("eda_23_annual_churn_change")
def eda_annual_churn_change(wh: Warehouse) -> DataFrame:
    annual = segments.counts_by(_churned_rows(wh), {"churn_year": F.year("churn_date")}, "churned_customers")
    return segments.period_change(annual, "churn_year", "churned_customers", "prior_year_churned", "yoy_change",
                                  "yoy_change_pct")


@query("eda_24_churn_by_month_of_year")
def eda_churn_by_month_of_year(wh: Warehouse) -> DataFrame:
    return segments.counts_by(_churned_rows(wh), {"churn_month_number": F.month("churn_date"),
                                                  "churn_month_name": month_name("churn_date")}, "churned_customers")


@query("eda_25_mean_median_gap")
def eda_mean_median_gap(wh: Warehouse) -> DataFrame:
    return segments.skew_gap(wh.base(), [("monthly_income", 0, "income"), ("avg_monthly_balance", 2, "balance")],
                             where=F.col("monthly_income").isNotNull(), stable_input=True,
                             sketches={m: _sketch(wh, m, where=F.col("income_known")) for m in ("monthly_income", "avg_monthly_balance")})


@query("eda_26_balance_deciles")
def eda_balance_deciles(wh: Warehouse) -> DataFrame:
    rows = wh.base().filter(F.col("is_outlier_balance") == 0)
    return segments.ntile_share(rows, "avg_monthly_balance", "customer_id", 10, "balance_decile", "customer_count",
                                "total_balance", "pct_of_total_balance", stable_input=True,
                                sketch=_sketch(wh, "avg_monthly_balance", where=F.col("is_outlier_balance") == 0))


@query("eda_27_outlier_sensitivity")
def eda_outlier_sensitivity(wh: Warehouse) -> DataFrame:
    return segments.outlier_sensitivity(wh.base(), "avg_monthly_balance", "churned", 0.99,
                                        ("Including top 1%", "Excluding top 1%"), stable_input=True,
                                        sketch=_sketch(wh, "avg_monthly_balance"))


# ---------------------------------------------------------- wide table (S05)


@query("w_01_product_portfolio")
def w_product_portfolio(wh: Warehouse) -> DataFrame:
    return wh.holdings()


@query("w_02_churn_analysis")
def w_churn_analysis(wh: Warehouse) -> DataFrame:
    return wh.churn_analysis()


@query("v_08_wide_rows")
def v_wide_rows(wh: Warehouse) -> DataFrame:
    return quality.row_count(wh.churn_analysis())


@query("v_09_wide_duplicates")
def v_wide_duplicates(wh: Warehouse) -> DataFrame:
    return quality.duplicate_keys(wh.churn_analysis(), ["customer_id"])


@query("v_10_wide_by_churned")
def v_wide_by_churned(wh: Warehouse) -> DataFrame:
    return quality.value_counts(wh.churn_analysis(), "churned", "customer_count")


@query("v_11_wide_by_products")
def v_wide_by_products(wh: Warehouse) -> DataFrame:
    return quality.value_counts(wh.churn_analysis(), "total_products", "customer_count")


@query("v_12_wide_by_province")
def v_wide_by_province(wh: Warehouse) -> DataFrame:
    return quality.value_counts(wh.churn_analysis(), "province", "customer_count")


@query("v_13_churn_date_range")
def v_churn_date_range(wh: Warehouse) -> DataFrame:
    rows = wh.churn_analysis().filter(F.col("churn_date").isNotNull())
    return rows.agg(F.min("churn_date").alias("earliest_churn"), F.max("churn_date").alias("latest_churn"))


# --------------------------------------------------------- star schema (S06)


@query("ss_1_dim_customer")
def ss_dim_customer(wh: Warehouse) -> DataFrame:
    return wh.dim_customer()


@query("ss_2_dim_product")
def ss_dim_product(wh: Warehouse) -> DataFrame:
    return wh.dim_product()


@query("ss_3_calendar_use")
def ss_calendar_use(wh: Warehouse) -> DataFrame:
    """The calendar (all its attributes) on the days that facts refer to."""
    return model.calendar_use(wh.fact_churn(), wh.dim_date())


@query("ss_4_fact_churn")
def ss_fact_churn(wh: Warehouse) -> DataFrame:
    return wh.fact_churn()


@query("v_14_star_row_counts")
def v_star_row_counts(wh: Warehouse) -> DataFrame:
    return quality.row_counts({
        "staging.dim_customer": wh.dim_customer(),
        "staging.dim_product": wh.dim_product(),
        "staging.dim_date": wh.dim_date(),
        "staging.fact_churn": wh.fact_churn(),
    })


@query("v_15_fact_rows")
def v_fact_rows(wh: Warehouse) -> DataFrame:
    return quality.row_count(wh.fact_churn(), "fact_churn_rows")


@query("v_16_wide_rows")
def v_wide_rows_star(wh: Warehouse) -> DataFrame:
    return quality.row_count(wh.churn_analysis(), "churn_analysis_rows")


@query("v_17_unmatched_customer_keys")
def v_unmatched_customer_keys(wh: Warehouse) -> DataFrame:
    return model.unmatched_keys(wh.fact_churn(), wh.dim_customer(), "customer_key", "customer_key",
                                "unmatched_customer_keys", hot=wh.fact_hot("customer_key"))


@query("v_18_unmatched_product_keys")
def v_unmatched_product_keys(wh: Warehouse) -> DataFrame:
    return model.unmatched_keys(wh.fact_churn(), wh.dim_product(), "product_key", "product_key",
                                "unmatched_product_keys", hot=wh.fact_hot("product_key"))


@query("v_19_unmatched_join_date_keys")
def v_unmatched_join_date_keys(wh: Warehouse) -> DataFrame:
    return model.unmatched_keys(wh.fact_churn(), wh.dim_date(), "join_date_key", "date_key",
                                "unmatched_join_date_keys", skip_null=True, small_dim=True)


@query("v_20_unmatched_churn_date_keys")
def v_unmatched_churn_date_keys(wh: Warehouse) -> DataFrame:
    return model.unmatched_keys(wh.fact_churn(), wh.dim_date(), "churn_date_key", "date_key",
                                "unmatched_churn_date_keys", skip_null=True, small_dim=True)


@query("v_21_reconcile_rate")
def v_reconcile_rate(wh: Warehouse) -> DataFrame:
    return model.reconcile({"fact_churn": wh.fact_churn(), "churn_analysis": wh.churn_analysis()})
