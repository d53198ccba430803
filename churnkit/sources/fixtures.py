"""Adapter tables: the reference's three raw tables built from the test tables.

The reference ships no data, so stand-ins with its shape and its kinds of
defects are derived from ``customer``, ``nation``, ``region`` and
``orders`` (see FIXTURES.md). Everything is a per-row expression over a
join of the customer table with per-customer order statistics: one
aggregation of ``orders`` by customer (partial aggregation first, so a
customer with very many orders costs no more than a few rows per task),
and two lookups into ``nation`` / ``region``, which are fixed-size
dimension tables (25 and 5 rows in every scale factor) and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the fixtures (FIXTURES.md), in their listed order.
GENDER_SPELLINGS = ("M", "Male", " male ", "F", "FEMALE", None)  # by k % 6
PRODUCT_SPELLINGS = {  # by order priority, then by k % 3
    "1-URGENT": ("Cheque Account", "cheque acc", " CA"),
    "2-HIGH": ("Savings Account", "SAVINGS ACC", "SA"),
    "3-MEDIUM": ("Home Loan", "home ln", "HL"),
    "4-NOT SPECIFIED": ("Credit Card", "CREDIT CRD ", "cc"),
}
OTHER_PRODUCT_SPELLINGS = ("Personal Loan", "personal ln", "PL", "Gift Card")  # by k % 4
# Branch codes (chosen here; FIXTURES.md leaves them to the build), by k % 5.
BRANCH_SPELLINGS = ("JHB-CBD", " jhb-cbd ", "CPT-WTF", None, "DBN-UMH")

DOB_BASE = "1930-01-01"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index: Column) -> Column:
    """The ``index``-th of a fixed list of literals (NULL allowed)."""
    out = None
    for i, v in enumerate(values):
        cond = index == i
        lit = F.lit(v).cast("string")
        out = F.when(cond, lit) if out is None else out.when(cond, lit)
    return out


def _id(prefix: Column | str, k: Column) -> Column:
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(p, F.lpad(k.cast("string"), 9, "0"))


def _order_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_custkey").alias("k")).agg(
        F.min("o_orderdate").cast("date").alias("fo"),
        F.max("o_orderdate").cast("date").alias("lo"),
        F.count(F.lit(1)).alias("n"),
    )


def _customers_with_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = _read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")
    return customer.join(F.broadcast(geo), customer.c_nationkey == geo.n_nationkey, "left").select(
        F.col("c_custkey").alias("k"), "c_name", "c_acctbal", "r_name"
    )


def _as_text(d: Column) -> Column:
    return d.cast("string")


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _customers_with_region(spark, sf_dir).join(_order_stats(spark, sf_dir).select("k", "fo"), "k", "left")
    k = F.col("k")
    rows = base.withColumn(
        "dup", F.explode(F.when(k % 50 == 7, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    )
    r_name = F.col("r_name")
    fo = F.col("fo")
    return rows.select(
        _id("C", k).alias("customer_id"),
        F.substring_index("c_name", "#", 1).alias("first_name"),
        F.substring_index("c_name", "#", -1).alias("last_name"),
        F.when(k % 37 == 0, F.lit(None).cast("string"))
        .otherwise(_as_text(F.date_add(F.lit(DOB_BASE).cast("date"), ((k * 7919) % 20000).cast("int"))))
        .alias("date_of_birth"),
        _pick(GENDER_SPELLINGS, k % 6).alias("gender"),
        F.when(k % 4 == 1, F.concat(F.lit(" "), F.lower(r_name), F.lit(" ")))
        .when(k % 4 == 2, F.substring(r_name, 1, 2))
        .otherwise(r_name)
        .alias("province"),
        _pick(BRANCH_SPELLINGS, k % 5).alias("branch_code"),
        F.when(k % 53 == 0, F.lit("2031-01-01"))
        .when(k % 41 == 0, F.lit("unknown"))
        .when(k % 5 == 0, _as_text(F.date_add(fo, ((k * 37) % 2400).cast("int"))))
        .otherwise(_as_text(F.date_sub(fo, (k % 300).cast("int"))))
        .alias("join_date"),
        F.when(k % 29 == 0, F.lit(None).cast("string"))
        .when(k % 3 == 0, F.lit("Inactive"))
        .otherwise(F.lit("Active"))
        .alias("account_status"),
        F.when(k % 31 == 0, F.lit(None).cast("string"))
        .when(k % 97 == 0, F.lit("n/a"))
        .otherwise(F.concat((F.lit(3500) + (k * 7919) % 80000 + F.col("dup") * 500).cast("string"), F.lit(".0")))
        .alias("monthly_income"),
    )


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One product row per (customer, order priority) with at least three orders.

    Every order is read and counted; a customer holds the products they have
    ordered under often enough, so some customers hold none, which the
    wide-table/fact difference needs.
    """
    orders = _read(spark, sf_dir, "orders")
    groups = (
        orders.groupBy(F.col("o_custkey").alias("k"), "o_orderpriority")
        .agg(F.count(F.lit(1)).alias("n"), F.min("o_orderdate").cast("date").alias("fo"), F.min("o_orderstatus").alias("st"))
        .filter(F.col("n") >= 3)
    )
    k = F.col("k")
    prio = F.col("o_orderpriority")
    name = None
    for p, spellings in PRODUCT_SPELLINGS.items():
        cond = prio == p
        value = _pick(spellings, k % 3)
        name = F.when(cond, value) if name is None else name.when(cond, value)
    name = name.otherwise(_pick(OTHER_PRODUCT_SPELLINGS, k % 4))
    return groups.select(
        _id("C", k).alias("customer_id"),
        name.alias("product_name"),
        F.when(k % 43 == 0, F.lit(None).cast("string"))
        .when(k % 19 == 0, F.lit("1990-01-01"))
        .otherwise(_as_text(F.col("fo")))
        .alias("open_date"),
        F.when(k % 23 == 0, F.lit(None).cast("string"))
        .when(F.col("st") == "F", F.lit("Closed"))
        .otherwise(F.lit("Active"))
        .alias("product_status"),
    )


def raw_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal")
    base = customer.join(_order_stats(spark, sf_dir), "k", "left")
    k = F.col("k")
    rows = base.withColumn(
        "prefix", F.explode(F.when(k % 150 == 5, F.array(F.lit("C"), F.lit("X"))).otherwise(F.array(F.lit("C"))))
    )
    n = F.coalesce(F.col("n"), F.lit(0))
    lo = F.col("lo")
    churned = (k * 13) % 9 < 2
    return rows.select(
        _id(F.col("prefix"), k).alias("customer_id"),
        F.when(k % 61 == 0, F.lit(None).cast("string"))
        .when(k % 1499 == 11, F.lit("4200000.0"))
        .otherwise(F.concat(F.floor(F.col("c_acctbal") * 25).cast("bigint").cast("string"), F.lit(".0")))
        .alias("avg_monthly_balance"),
        F.when(k % 17 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat((F.lit(290) + (k * 31) % 580).cast("string"), F.lit(".0")))
        .alias("credit_score"),
        F.when(k % 47 == 0, F.lit(None).cast("string")).otherwise(((n * 3) % 25).cast("string")).alias("num_transactions_3m"),
        F.when((k * 7) % 10 < 6, F.lit("1")).otherwise(F.lit("0")).alias("is_active_member"),
        F.when(k % 59 == 0, F.lit("1990-06-01")).otherwise(_as_text(lo)).alias("last_txn_date"),
        F.when(churned, F.lit("1")).otherwise(F.lit("0")).alias("churned"),
        F.when(churned, _as_text(lo)).alias("churn_date"),
    )


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "customers": raw_customers(spark, sf_dir),
        "products": raw_products(spark, sf_dir),
        "activity": raw_activity(spark, sf_dir),
    }
