"""Declared schemas of the raw layer: every column a nullable string."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_CUSTOMER_COLUMNS = (
    "customer_id", "first_name", "last_name", "date_of_birth", "gender", "province",
    "branch_code", "join_date", "account_status", "monthly_income",
)
RAW_PRODUCT_COLUMNS = ("customer_id", "product_name", "open_date", "product_status")
RAW_ACTIVITY_COLUMNS = (
    "customer_id", "avg_monthly_balance", "credit_score", "num_transactions_3m",
    "is_active_member", "last_txn_date", "churned", "churn_date",
)


def all_string(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])


RAW_CUSTOMERS = all_string(RAW_CUSTOMER_COLUMNS)
RAW_PRODUCTS = all_string(RAW_PRODUCT_COLUMNS)
RAW_ACTIVITY = all_string(RAW_ACTIVITY_COLUMNS)

RAW_SCHEMAS = {"customers": RAW_CUSTOMERS, "products": RAW_PRODUCTS, "activity": RAW_ACTIVITY}
