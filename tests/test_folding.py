"""Opt-in text comparison without regard to case and trailing spaces; the default compares exactly."""

import pytest
from pyspark.sql import functions as F

from churnkit.config import BANK
from churnkit.functions import folded
from churnkit.plans.queries import QUERIES
from churnkit.plans.warehouse import AS_LOADED, Warehouse

CUSTOMERS = """customer_id,first_name,last_name,date_of_birth,gender,province,branch_code,join_date,account_status,monthly_income
C001,A,A,1980-01-01,Male,Gauteng,B1,2016-01-01,Active,500
c001,B,B,1980-01-01,male,GAUTENG,B1,2015-06-01,active,100
"C001 ",C,C,1980-01-01,"Male ",gauteng,B1,2017-01-01,ACTIVE,900
" C001",D,D,1980-01-01," Male",Gauteng,B1,2018-01-01,Closed,50
C002,E,E,1990-01-01,Female,Gauteng,B1,2019-01-01,"active ",700
"""
PRODUCTS = """customer_id,product_name,open_date,product_status
c001,Home Loan,2016-01-01,Active
C001,HOME LOAN,2014-01-01,"active "
C002,"Home Loan ",2020-01-01,CLOSED
c003,Home Loan,2020-01-01,Closed
"""
ACTIVITY = """customer_id,avg_monthly_balance,credit_score,num_transactions_3m,is_active_member,last_txn_date,churned,churn_date
"c001  ",100.0,600,3,1,2024-01-01,"1 ",2024-02-01
C002,200.0,700,5,0,2018-01-01,0,
C9,300.0,700,5,0,2024-01-01,0,
"""


@pytest.fixture(scope="module")
def paths(tmp_path_factory):
    root = tmp_path_factory.mktemp("folding")
    out = {}
    for name, text in (("customers", CUSTOMERS), ("products", PRODUCTS), ("activity", ACTIVITY)):
        (root / name).mkdir()
        (root / name / "part.csv").write_text(text)
        out[name] = str(root / name)
    return out


@pytest.fixture(scope="module")
def both(spark, paths):
    return {fold: Warehouse.from_csv(spark, paths, BANK.with_folded_text() if fold else BANK) for fold in (False, True)}


def _rows(wh, name, *columns):
    return sorted((tuple(r) for r in QUERIES[name](wh).select(*columns).collect()), key=str)


def test_folded_key(spark):
    texts = ["C1", "c1", "c1  ", " c1", "", "  ", None, "c1\t"]
    found = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(folded("t")).collect()]
    assert found == ["C1", "C1", "C1", " C1", "", "", None, "C1\t"]


def test_ids(both):
    assert _rows(both[False], "dq_03a_duplicate_ids", "customer_id", "occurrence_count") == []
    assert _rows(both[True], "dq_03a_duplicate_ids", "customer_id", "occurrence_count") == [("C001", 3)]
    assert len(_rows(both[True], "dq_03b_duplicate_rows", "customer_id")) == 3
    # the lowest income of the three spellings is kept; a leading space makes another id
    assert _rows(both[True], "st_11_staging_customers", "customer_id", "first_name") == [(" C001", "D"), ("C001", "B"), ("C002", "E")]
    assert len(_rows(both[False], "st_11_staging_customers", "customer_id")) == 5
    loaded = both[True].loaded("customers").select(AS_LOADED).collect()
    assert sorted(r[0] for r in loaded) == [" C001", "C001", "C001 ", "C002", "c001"]
    assert AS_LOADED not in both[True].raw("customers").columns


def test_joins(both):
    assert _rows(both[True], "dq_16_orphan_activity", "orphan_records") == [(1,)]
    assert _rows(both[False], "dq_16_orphan_activity", "orphan_records") == [(2,)]
    assert _rows(both[True], "dq_13_open_before_join", F.col("open_before_join")) == [(1,)]  # 2014 is before the earliest of three dates
    assert _rows(both[True], "dq_17_txn_before_join", "txn_before_join") == [(1,)]
    assert _rows(both[True], "w_01_product_portfolio", "customer_id", "total_products", "active_products", "closed_products") == [
        ("C001", 2, 2, 0), ("C002", 1, 0, 1), ("C003", 1, 0, 1)]
    assert _rows(both[True], "eda_00_base", "customer_id", "churned") == [("C001", 1), ("C002", 0)]
    assert len(_rows(both[True], "ss_4_fact_churn", "customer_key")) == 2


def test_variants_and_statuses(both):
    assert _rows(both[True], "dq_04_gender_variants", "gender", "count") == [(" Male", 1), ("Female", 1), ("Male", 3)]
    assert len(_rows(both[False], "dq_04_gender_variants", "gender", "count")) == 5
    assert _rows(both[True], "dq_05_province_variants", "province", "count") == [("GAUTENG", 5)]
    assert _rows(both[True], "dq_10_product_variants", "product_name", "count") == [("HOME LOAN", 4)]
    log = {r["metric"]: r["value"] for r in QUERIES["dq_00_quality_log"](both[True]).collect()}
    assert (log["gender_variants"], log["province_variants"], log["product_name_variants"], log["duplicate_ids"]) == (3, 1, 1, 1)
    assert log["churned_with_date"] == 1 and log["churned_missing_date"] == 0
    assert [(s.strip().lower(), n) for s, n, _ in _rows(both[True], "eda_05_account_status_share", "account_status", "total_customers", "pct_of_total")] == [("active", 2)]
    assert {s.upper().strip(): n for s, n in _rows(both[True], "eda_09_product_status_share", "product_status", "total_products")} == {"ACTIVE": 2, "CLOSED": 1}
