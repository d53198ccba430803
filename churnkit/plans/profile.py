"""The counting checks of each raw table as aggregates, taken together in one pass (while it is loaded)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from churnkit import config as C
from churnkit.config import ChurnConfig
from churnkit.functions import date_lit, folded, to_date, to_float, to_int_via_float
from churnkit.sources.csv import MALFORMED

CUSTOMER_NULLS = {
    "null_customer_id": "customer_id", "null_dob": "date_of_birth", "null_gender": "gender",
    "null_province": "province", "null_join_date": "join_date", "null_account_status": "account_status",
    "null_monthly_income": "monthly_income",
}
ACTIVITY_NULLS = {
    "null_customer_id": "customer_id", "null_balance": "avg_monthly_balance", "null_credit_score": "credit_score",
    "null_txn_count": "num_transactions_3m", "null_active_member": "is_active_member",
    "null_last_txn": "last_txn_date", "null_churned": "churned", "null_churn_date": "churn_date",
}
#: Which metrics of a table make up which check, in the order of its columns.
CHECKS: dict[str, dict[str, tuple[str, ...]]] = {
    "customers": {
        "L-04": ("malformed_customers_rows",), "DQ-01": ("total_rows",), "DQ-02": tuple(CUSTOMER_NULLS), "DQ-06": ("future_join_dates",),
        "DQ-07": ("unparseable_income_value", "zero_or_negative_income"), "DQ-08": ("null_account_status",),
    },
    "products": {"L-04": ("malformed_products_rows",), "DQ-09": ("total_rows",), "DQ-11": ("null_product_status",), "DQ-12": ("suspect_open_dates",)},
    "activity": {
        "L-04": ("malformed_activity_rows",), "DQ-14": ("total_rows",), "DQ-15": tuple(ACTIVITY_NULLS),
        "DQ-18": ("churned_with_date", "not_churned_without_date", "churned_missing_date", "not_churned_has_date"),
        "DQ-19": ("below_minimum", "above_maximum"),
    },
}


def _nulls(check: str, names: dict[str, str]) -> dict[str, Column]:
    # like SUM(CASE WHEN c IS NULL THEN 1 ELSE 0 END), NULL over no rows
    return {f"{check}.{name}": F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)) for name, c in names.items()}


def _where(check: str, conditions: dict[str, Column]) -> dict[str, Column]:
    return {f"{check}.{name}": F.count(F.when(cond, F.lit(1))) for name, cond in conditions.items()}


def profile_metrics(table: str, cfg: ChurnConfig) -> dict[str, Column]:
    """``check.metric`` -> aggregate, for every metric in ``CHECKS[table]``."""
    rows = F.count(F.lit(1))
    out = {f"L-04.malformed_{table}_rows": F.count(MALFORMED)}
    if table == "customers":
        income = to_float("monthly_income")
        return out | {"DQ-01.total_rows": rows} | _nulls("DQ-02", CUSTOMER_NULLS) | _where(
            "DQ-06", {"future_join_dates": to_date("join_date") > date_lit(cfg.reference_date)}) | _where(
            "DQ-07", {"unparseable_income_value": income.isNull(), "zero_or_negative_income": income <= 0}) | _where(
            "DQ-08", {"null_account_status": F.col("account_status").isNull()})
    if table == "products":
        return out | {"DQ-09.total_rows": rows} | _where(
            "DQ-11", {"null_product_status": F.col("product_status").isNull()}) | _where(
            "DQ-12", {"suspect_open_dates": to_date("open_date") < date_lit(cfg.inception_date)})
    churned, date = folded("churned") if cfg.fold_text else F.col("churned"), F.col("churn_date")
    known, score = to_float("credit_score").isNotNull(), to_int_via_float("credit_score")
    return out | {"DQ-14.total_rows": rows} | _nulls("DQ-15", ACTIVITY_NULLS) | _where("DQ-18", {
        "churned_with_date": (churned == "1") & date.isNotNull(), "not_churned_without_date": (churned == "0") & date.isNull(),
        "churned_missing_date": (churned == "1") & date.isNull(), "not_churned_has_date": (churned == "0") & date.isNotNull(),
    }) | _where("DQ-19", {"below_minimum": known & (score < C.CREDIT_SCORE_MIN), "above_maximum": known & (score > C.CREDIT_SCORE_MAX)})
