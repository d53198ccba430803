"""A customer holding a third of the rows: same results with and without the hot-key path."""

import pytest
from pyspark.sql import functions as F

from churnkit.config import BANK
from churnkit.operators import joins, model
from churnkit.operators.dedupe import dedupe_first
from churnkit.plans import staging
from churnkit.sources.schemas import RAW_ACTIVITY, RAW_CUSTOMERS, RAW_PRODUCTS


def _raw(spark):
    customers = [(f"C{i}", "A", "B", "1980-01-01", "M", "GP", None, "2016-01-01", "Active", f"{5000 + i}.0")
                 for i in range(60)]
    customers += [("C0", "A", "B", "1980-01-01", "M", "GP", None, "2016-01-01", "Active", f"{9000 + j}.0")
                  for j in range(40)]  # C0 exported 41 times
    activity = [(f"C{i}", f"{1000 * i}.0", "600.0", "3", "1", "2020-01-01", str(i % 2), None) for i in range(60)]
    activity += [("C0", f"{j}.0", "600.0", "3", "0", "2021-01-01", "1", "2022-02-02") for j in range(40)]
    products = [(f"C{i % 60}", "HL", "2017-01-01", "Active") for i in range(90)]
    products += [("C0", "CC", "2018-01-01", "Closed") for _ in range(45)]
    return (spark.createDataFrame(customers, RAW_CUSTOMERS), spark.createDataFrame(products, RAW_PRODUCTS),
            spark.createDataFrame(activity, RAW_ACTIVITY))


def _pipeline(spark):
    rc, rp, ra = _raw(spark)
    c = staging.stage_customers(rc, BANK)
    p = staging.stage_products(rp, rc, BANK)
    a = staging.stage_activity(ra, rc, BANK)
    holdings = model.portfolio(p, BANK.product_names)
    out = {
        "customers": c, "products": p, "activity": a,
        "base": staging.analysis_base(c, a),
        "wide": model.wide_table(c, a, holdings, BANK.product_names),
    }
    fact = model.fact_churn(a, model.dim_customer(c), model.dim_product(holdings, BANK.product_names))
    keys = sorted(r[0] for r in fact.select("churn_fact_key").collect())
    assert keys == list(range(1, len(keys) + 1))  # dense; ties among one customer's rows are arbitrary
    out["fact"] = fact.drop("churn_fact_key")
    return {k: sorted(map(tuple, v.collect()), key=str) for k, v in out.items()}


def test_hot_customer_results_match_plain_joins(spark, monkeypatch):
    plain = _pipeline(spark)  # far too few rows for a hot key
    monkeypatch.setattr(joins, "HOT_MIN_ROWS", 30)  # C0 is hot in activity and products
    rc, rp, ra = _raw(spark)
    assert [k for k, _ in joins.hot_keys(ra, "customer_id").rows] == ["C0"]
    assert [k for k, _ in joins.hot_keys(rp, "customer_id").rows] == ["C0"]
    split = _pipeline(spark)
    assert split == plain
    assert len(plain["activity"]) == 100 and len(plain["base"]) == 100
    assert len(plain["fact"]) == 100  # activity is not deduplicated, so C0 fans out


def test_dedupe_of_a_hot_key_keeps_the_lowest_income(spark):
    rows = [("K", str(1000 - i)) for i in range(500)] + [("K", None), ("J", "5")]
    df = spark.createDataFrame(rows, "customer_id string, monthly_income string")
    kept = {r["customer_id"]: r["monthly_income"] for r in
            dedupe_first(df, ["customer_id"], [F.col("monthly_income").cast("double")]).collect()}
    assert kept == {"K": None, "J": "5"}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_keeps_null_keys_like_a_plain_join(spark, how):
    big = spark.createDataFrame([("H", 1)] * 50 + [(None, 2), ("A", 3)], "k string, v int")
    other = spark.createDataFrame([("H", 10), ("A", 30), (None, 99)], "k string, w int")
    got = sorted(map(tuple, joins.skew_join(big, other, "k", how, hot=joins.HotKeys((("H", 3),))).collect()), key=str)
    want = sorted(map(tuple, big.join(other, "k", how).collect()), key=str)
    assert got == want


def test_a_stored_layer_observes_its_hot_keys_in_the_same_pass(spark):
    from churnkit.session import materialize_observed

    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit("H")).when(F.col("id") % 3 == 1, F.concat(F.lit("K"), "id")).alias("k"))
    table, seen = materialize_observed(rows, "observed", {**joins.key_metrics(spark, "k"), "n": F.count(F.lit(1))})
    assert table.count() == seen["n"] == 60_000
    (hot,) = joins.observed_keys(spark, seen, "k").rows
    assert hot[0] == "H" and hot[1] >= 4  # 20,000 of 40,000 rows over 8 partitions
    (same,) = joins.hot_keys(table, "k").rows
    assert same == hot


@pytest.mark.parametrize("hot", [None, "K"])
def test_dedupe_in_two_phases_matches_a_window(spark, hot):
    from pyspark.sql import Window

    rows = [("K", i % 7, str(i)) for i in range(300)] + [(f"A{i}", i, "x") for i in range(50)] + [(None, 3, "c"), (None, None, "b"), ("Z", None, "q"), ("Z", None, "p"), ("Z", 1, "a")]
    rows += [("E", 1, "same")] * 3
    df = spark.createDataFrame(rows, "k string, v int, w string").repartition(5)
    w = Window.partitionBy("k").orderBy(F.col("v").asc_nulls_first(), F.col("w").asc_nulls_first())
    want = df.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
    got = dedupe_first(df, ["k"], [F.col("v")], joins.HotKeys(((hot, 4),)) if hot else None)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_join_with_a_hot_key_reads_each_side_once(spark, tmp_path):
    spark.range(5000).selectExpr("if(id % 2 = 0, 'H', concat('K', id)) AS k", "id").write.parquet(str(tmp_path / "big"))
    spark.range(600).selectExpr("if(id = 0, 'H', concat('K', id)) AS k", "id * 10 AS w").write.parquet(str(tmp_path / "other"))
    big, other = (spark.read.parquet(str(tmp_path / n)) for n in ("big", "other"))
    joined = joins.skew_join(big, other.groupBy("k").agg(F.sum("w").alias("w")), "k", hot=joins.HotKeys((("H", 5),)))
    plan = joined._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan parquet") == 2 and "Union" not in plan
    assert joined.count() == big.join(other, "k").count()
