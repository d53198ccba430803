"""Hand-made rows for each cleaning rule of the reference (bank configuration)."""

import datetime as dt

import pytest

from churnkit.config import BANK
from churnkit.operators import model, segments
from churnkit.plans import staging
from churnkit.sources.schemas import RAW_ACTIVITY, RAW_CUSTOMERS, RAW_PRODUCTS

CUSTOMERS = [
    # id, first, last, dob, gender, province, branch, join, status, income
    ("C1", "Ann", "A", "1950-06-15", " male ", "gp", "jhb-cbd", "2016-03-01", None, "5000.0"),
    ("C2", "Bo", "B", "1980-01-01", "F", "KZN", "PTA-1", "2018-01-01", "Active", "8000.0"),
    ("C2", "Bo", "B", "1980-01-01", "F", "KZN", "PTA-1", "2018-01-01", "Active", None),  # NULL income wins
    ("C3", "Cy", "C", "2007-01-01", "FEMALE", "w cape", None, "unknown", "Inactive", "n/a"),  # age 17
    ("C4", "Di", "D", "1959-12-31", "x", "Nowhere", None, "2031-01-01", "Active", "60000.0"),  # age 65
    ("C5", "Ed", "E", "1958-01-01", None, "LIMPOP", None, "2024-06-30", "Active", "15000.0"),  # age 66
    (None, "No", "Id", "1970-01-01", "M", "GP", None, "2019-01-01", "Active", "1.0"),  # NULL id
]
PRODUCTS = [
    ("C1", "cheque acc", "2017-01-01", "Active"),
    ("C1", "HL", "2010-05-05", None),  # before inception
    ("C1", "Gift Card", "2016-01-01", "Closed"),  # before joining, unmapped name
    ("C3", " CA", "2016-01-01", "Active"),  # customer without a valid join date: flag stays 1
    ("C2", "SAVINGS ACC", None, "Closed"),
]
ACTIVITY = [
    # id, balance, score, txn, active, last txn, churned, churn date
    ("C1", None, "518.0", "12", "1", "2020-01-01", "1", None),
    ("C2", "4200000.0", "900.0", "0", "0", "2017-01-01", "0", None),
    ("C3", "-10.5", None, "12.0", "0", None, "1", "2023-05-01"),
    ("C4", "60000.123", "449.9", "-2", "1", "2024-01-01", "0", None),
    ("C5", "50000.0", "750.0", "25", "0", "2024-07-01", "1", "2024-09-30"),
    ("X9", "1.0", "600.0", "1", "1", "2020-01-01", "0", None),  # orphan
]


@pytest.fixture(scope="module")
def tables(spark):
    rc = spark.createDataFrame(CUSTOMERS, RAW_CUSTOMERS)
    rp = spark.createDataFrame(PRODUCTS, RAW_PRODUCTS)
    ra = spark.createDataFrame(ACTIVITY, RAW_ACTIVITY)
    c = staging.stage_customers(rc, BANK)
    p = staging.stage_products(rp, rc, BANK)
    a = staging.stage_activity(ra, rc, BANK)
    return {
        "c": {r["customer_id"]: r for r in c.collect()},
        "p": p.collect(),
        "a": {r["customer_id"]: r for r in a.collect()},
        "c_df": c, "a_df": a, "p_df": p,
    }


def test_dedupe_keeps_null_income_and_drops_null_id(tables):
    c = tables["c"]
    assert sorted(c) == ["C1", "C2", "C3", "C4", "C5"]
    assert c["C2"]["monthly_income"] is None and c["C2"]["income_tier"] == "Unknown"


def test_customer_cleaning(tables):
    c1 = tables["c"]["C1"]
    assert (c1["gender"], c1["province"], c1["branch_code"], c1["account_status"]) == (
        "Male", "Gauteng", "Johannesburg CBD", "Unknown")
    assert c1["age"] == 74 and c1["age_band"] == "65+"
    assert c1["tenure_days"] == (dt.date(2024, 12, 31) - dt.date(2016, 3, 1)).days
    assert c1["tenure_band"] == "5+ Years" and c1["income_tier"] == "Below R7,000"
    c = tables["c"]
    assert (c["C3"]["age"], c["C3"]["age_band"]) == (17, "Unknown")
    assert (c["C4"]["age"], c["C4"]["age_band"]) == (65, "56-65")
    assert (c["C5"]["age"], c["C5"]["age_band"]) == (66, "65+")
    assert c["C3"]["province"] == "Western Cape" and c["C4"]["province"] == "Unknown"
    assert c["C4"]["gender"] == "Unknown" and c["C5"]["gender"] == "Unknown"
    assert c["C4"]["income_tier"] == "R60,000 & above"


def test_join_date_validity(tables):
    c = tables["c"]
    assert c["C3"]["is_valid_join_date"] == 0 and c["C3"]["tenure_days"] is None
    assert c["C3"]["tenure_band"] == "Unknown"
    assert c["C4"]["join_date"] == dt.date(2031, 1, 1) and c["C4"]["is_valid_join_date"] == 0
    assert c["C5"]["tenure_band"] == "Less than 1 Year"


def test_product_rules(tables):
    rows = {(r["customer_id"], r["product_name"], r["open_date"]): r for r in tables["p"]}
    assert len(tables["p"]) == 5  # products are neither deduplicated nor filtered
    assert rows[("C1", "Cheque Account", dt.date(2017, 1, 1))]["is_valid_open_date"] == 1
    hl = rows[("C1", "Home Loan", dt.date(2010, 5, 5))]
    assert hl["is_valid_open_date"] == 0 and hl["product_status"] == "Unknown"
    assert rows[("C1", "Unknown", dt.date(2016, 1, 1))]["is_valid_open_date"] == 0
    assert rows[("C3", "Cheque Account", dt.date(2016, 1, 1))]["is_valid_open_date"] == 1
    assert rows[("C2", "Savings Account", None)]["is_valid_open_date"] == 0


def test_activity_rules(tables):
    a = tables["a"]
    assert sorted(a) == ["C1", "C2", "C3", "C4", "C5"]  # orphan dropped
    assert a["C1"]["avg_monthly_balance"] is None
    assert a["C1"]["balance_tier"] == "R200,000 & above" and a["C1"]["is_outlier_balance"] == 0
    assert (a["C1"]["credit_score"], a["C1"]["credit_band"]) == (518, "Fair")
    assert a["C1"]["churned"] == 1 and a["C1"]["churn_date"] is None
    assert a["C2"]["is_outlier_balance"] == 1 and a["C2"]["credit_band"] == "Excellent"
    assert a["C2"]["is_valid_last_txn"] == 0  # before joining
    assert a["C3"]["balance_tier"] == "Overdrawn" and a["C3"]["credit_band"] == "Unknown"
    assert a["C3"]["num_transactions_3m"] is None  # "12.0" is not an integer
    assert a["C3"]["is_valid_last_txn"] == 0  # no date
    assert a["C4"]["avg_monthly_balance"] == 60000.12 and a["C4"]["balance_tier"] == "R50,000 - R199,999"
    assert (a["C4"]["credit_score"], a["C4"]["credit_band"]) == (449, "Poor")
    assert a["C4"]["is_valid_last_txn"] == 1  # no valid join date: comparison unknown, flag stays 1
    assert a["C5"]["credit_band"] == "Excellent"


def test_wide_table_keeps_customers_without_products_fact_does_not(spark, tables):
    holdings = model.portfolio(tables["p_df"], BANK.product_names)
    wide = model.wide_table(tables["c_df"], tables["a_df"], holdings, BANK.product_names)
    w = {r["customer_id"]: r for r in wide.collect()}
    assert sorted(w) == ["C1", "C2", "C3", "C4", "C5"]
    assert w["C4"]["total_products"] is None
    assert (w["C1"]["total_products"], w["C1"]["active_products"], w["C1"]["closed_products"]) == (3, 1, 1)
    assert (w["C1"]["has_cheque_account"], w["C1"]["has_home_loan"], w["C1"]["has_credit_card"]) == (1, 1, 0)
    assert w["C5"]["churn_year_month"] == "2024-09" and w["C5"]["churn_quarter"] == 3
    assert w["C5"]["churn_month_name"] == "September"
    dc = model.dim_customer(tables["c_df"])
    dp = model.dim_product(holdings, BANK.product_names)
    keys = {r["customer_id"]: r["customer_key"] for r in dc.collect()}
    assert keys == {"C1": 1, "C2": 2, "C3": 3, "C4": 4, "C5": 5}
    fact = {r["customer_id"]: r for r in model.fact_churn(tables["a_df"], dc, dp).collect()}
    assert sorted(fact) == ["C1", "C2", "C3"]
    assert [fact[k]["churn_fact_key"] for k in ("C1", "C2", "C3")] == [1, 2, 3]
    assert fact["C1"]["join_date_key"] == 20160301 and fact["C1"]["churn_date_key"] is None
    assert fact["C3"]["join_date_key"] is None and fact["C3"]["churn_date_key"] == 20230501


def test_one_row_group_has_null_stdev(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("b", 1, 1.0), ("b", 1, 3.0)], "g string, churned int, v double")
    names = {"count": "n", "min": "lo", "max": "hi", "avg": "mean", "stdev": "sd", "median": "med"}
    out = {r["g"]: r for r in segments.summary_by(df, ["g", "churned"], "v", 2, names).collect()}
    assert out["a"]["sd"] is None and out["a"]["med"] == 10.0
    assert out["b"]["sd"] == 1.41 and out["b"]["med"] == 2.0


def test_rate_counts_null_flag_as_retained(spark):
    df = spark.createDataFrame([("x", 1), ("x", None), ("x", 0), ("y", None)], "k string, churned int")
    out = {r["k"]: r for r in segments.rate_by(df, ["k"]).collect()}
    assert (out["x"]["total_customers"], out["x"]["churned"], out["x"]["retained"]) == (3, 1, 2)
    assert out["x"]["churn_rate_pct"] == 33.33
    assert out["y"]["churned"] is None and out["y"]["churn_rate_pct"] is None


def test_tied_balances_deciles_are_stable(spark):
    rows = [(f"C{i:03d}", 100.0 if i < 6 else float(i)) for i in range(25)]
    df = spark.createDataFrame(rows, "customer_id string, avg_monthly_balance double")
    out = segments.ntile_share(df, "avg_monthly_balance", "customer_id", 10, "decile", "n", "total", "pct")
    got = sorted((r["decile"], r["n"], r["total"]) for r in out.collect())
    values = sorted((v for _, v in rows), reverse=True)
    sizes = [3] * 5 + [2] * 5
    expected, start = [], 0
    for t, size in enumerate(sizes, 1):
        expected.append((t, size, round(sum(values[start:start + size]), 0)))
        start += size
    assert got == expected


def test_tier_uses_unrounded_balance(spark):
    ra = spark.createDataFrame([("C1", "9999.996", None, None, None, None, "0", None)], RAW_ACTIVITY)
    rc = spark.createDataFrame([("C1",) + (None,) * 9], RAW_CUSTOMERS)
    row = staging.stage_activity(ra, rc, BANK).first()
    assert row["avg_monthly_balance"] == 10000.0  # stored rounded
    assert row["balance_tier"] == "R0 - R9,999"  # banded before rounding


def test_transaction_band_negative_counts_fall_in_first_band(spark):
    from churnkit import config as C
    from churnkit.functions import zero_then_band

    df = spark.createDataFrame([(-2,), (0,), (4,), (5,), (19,), (20,)], "t int")
    got = [r[0] for r in df.select(zero_then_band("t", C.TXN_ZERO_LABEL, C.TXN_BANDS, C.TXN_TOP)).collect()]
    assert got == ["1-4", "No Activity", "1-4", "5-9", "10-19", "20+"]


def test_earliest_join_date_is_taken_over_raw_duplicates(spark):
    # the kept row (lowest income) joined in 2019, its duplicate in 2017: products opened in 2018 are valid
    rc = spark.createDataFrame([
        ("C1", None, None, None, None, None, None, "2019-01-01", None, "100.0"),
        ("C1", None, None, None, None, None, None, "2017-01-01", None, "200.0"),
    ], RAW_CUSTOMERS)
    rp = spark.createDataFrame([("C1", "HL", "2018-01-01", "Active"), ("C1", "HL", "2016-12-31", "Active")],
                               RAW_PRODUCTS)
    kept = staging.stage_customers(rc, BANK).first()
    assert kept["join_date"] == dt.date(2019, 1, 1)
    flags = sorted((r["open_date"], r["is_valid_open_date"]) for r in staging.stage_products(rp, rc, BANK).collect())
    assert flags == [(dt.date(2016, 12, 31), 0), (dt.date(2018, 1, 1), 1)]


def test_ids_compare_in_binary(spark):
    rc = spark.createDataFrame([("c1",) + (None,) * 9, ("C1",) + (None,) * 9, ("C1 ",) + (None,) * 9],
                               RAW_CUSTOMERS)
    assert staging.stage_customers(rc, BANK).count() == 3
