
import __spark_entry__ as E

COVERAGE = {
    "L-1": "l_01_load_customers", "L-2": "l_02_load_products", "L-3": "l_03_load_activity",
    "L-4": "l_04_raw_row_counts",
    **{f"DQ-{i:02d}": q for i, q in {
        1: "dq_01_customer_rows", 2: "dq_02_customer_nulls", 4: "dq_04_gender_variants",
        5: "dq_05_province_variants", 6: "dq_06_future_join_dates", 7: "dq_07_income_validity",
        8: "dq_08_null_account_status", 9: "dq_09_product_rows", 10: "dq_10_product_variants",
        11: "dq_11_null_product_status", 12: "dq_12_open_before_inception", 13: "dq_13_open_before_join",
        14: "dq_14_activity_rows", 15: "dq_15_activity_nulls", 16: "dq_16_orphan_activity",
        17: "dq_17_txn_before_join", 18: "dq_18_churn_date_integrity", 19: "dq_19_credit_score_range"}.items()},
    "DQ-03a": "dq_03a_duplicate_ids", "DQ-03b": "dq_03b_duplicate_rows",
    "ST-1": "st_01_dedupe_customers", "ST-11": "st_11_staging_customers", "ST-14": "st_14_staging_products",
    "ST-20": "st_20_staging_activity",
    **{f"V-{i}": q for i, q in {
        1: "v_01_staging_row_counts", 2: "v_02_province_counts", 3: "v_03_gender_counts", 4: "v_04_product_counts",
        5: "v_05_duplicates_after_dedupe", 6: "v_06_active_member_counts", 7: "v_07_churned_counts",
        8: "v_08_wide_rows", 9: "v_09_wide_duplicates", 10: "v_10_wide_by_churned", 11: "v_11_wide_by_products",
        12: "v_12_wide_by_province", 13: "v_13_churn_date_range", 14: "v_14_star_row_counts",
        15: "v_15_fact_rows", 16: "v_16_wide_rows", 17: "v_17_unmatched_customer_keys",
        18: "v_18_unmatched_product_keys", 19: "v_19_unmatched_join_date_keys",
        20: "v_20_unmatched_churn_date_keys", 21: "v_21_reconcile_rate"}.items()},
    "W-1": "w_01_product_portfolio", "W-2": "w_02_churn_analysis",
    "SS-1": "ss_1_dim_customer", "SS-2": "ss_2_dim_product", "SS-3": "ss_3_calendar_use", "SS-4": "ss_4_fact_churn",
}


def test_every_survey_item_is_registered_with_an_oracle():
    queries, oracles = E.queries(), E.oracle_sql()
    eda = [q for q in queries if q.startswith("eda_")]
    assert sorted(int(q.split("_")[1]) for q in eda) == list(range(0, 28))  # EDA-00 .. EDA-27
    for item, name in COVERAGE.items():
        assert name in queries, item
        assert name in oracles, item
    # ST-2..10, 12, 13, 15..19 are columns of the staging tables above
