"""Physical plans: no whole-table single-task steps, pushdown, co-located joins."""

import pytest
from pyspark.sql import functions as F

from churnkit.config import FIXTURE
from churnkit.operators import model
from churnkit.operators.joins import HotKeys
from churnkit.operators.ordering import ntile, percentile_exact, rank_rows
from churnkit.plans import staging
from churnkit.plans.warehouse import Warehouse, fixture_warehouse

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def wh(spark):
    return fixture_warehouse(spark, SF)


def single_partition_inputs(p: str) -> list[str]:
    """The first operator below each single-partition exchange, looking through projections and filters."""
    lines = p.splitlines()
    out = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            rest = [x.lstrip(" :+-") for x in lines[i + 1:]]
            out.append(next((x for x in rest if not x.startswith(("Project", "Filter", "Sort "))), ""))
    return out


def test_ordering_helpers_never_use_unpartitioned_windows_over_rows(spark):
    df = spark.range(0, 5000).select(F.col("id"), (F.col("id") % 97).cast("double").alias("v"))
    for out in (rank_rows(df, [F.col("v")]), ntile(df, 10, [F.col("v").desc()]),
                percentile_exact(df, "v", 0.5)):
        p = plan(out)
        assert "rangepartitioning" not in p  # the sort happened once, into written files
        # windows either run over the small per-partition count table (on an aggregate) or
        # inside one sort partition (partitioned by the partition id, ordered by position)
        for segment in p.split("Window [")[1:]:
            spec = segment.split("specifiedwindowframe")[0]
            assert ("windowspecdefinition(_p#" in spec and "_m#" in spec) or \
                "HashAggregate" in segment.split("FileScan")[0]
        # a single-partition step only ever receives aggregated rows
        for child in single_partition_inputs(p):
            assert "HashAggregate" in child


def test_whole_table_window_would_be_single_partition(spark):
    """The literal form is what the helper avoids."""
    from pyspark.sql import Window

    df = spark.range(0, 100).withColumn("rn", F.row_number().over(Window.orderBy("id")))
    assert any("HashAggregate" not in child for child in single_partition_inputs(plan(df)))


def test_staging_reads_only_needed_columns_and_pushes_filters(wh):
    p = plan(wh.base().filter(F.col("churned") == 1).select("province", "churned"))
    assert "PushedFilters: [IsNotNull(churned), EqualTo(churned,1)]" in p
    assert "ReadSchema: struct<province:string,churned:int>" in p


def test_one_row_per_customer_tables_join_without_shuffle(spark, wh):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        known = wh.staging_customers().join(wh.holdings(), "customer_id", "left")
        p = plan(known)
        assert "SortMergeJoin" in p and "Exchange" not in p
        dims = wh.dim_customer().join(wh.dim_product(), "customer_id")
        assert "Exchange" not in plan(dims)
        # activity (unbucketed, possibly skewed) is the only side that moves
        base = staging.analysis_base(wh.staging_customers(), wh.staging_activity())
        p = plan(base)
        assert p.count("Exchange hashpartitioning(customer_id") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_buckets_follow_the_size_of_the_customer_export(spark, tmp_path, monkeypatch):
    """A task works on a whole bucket, so its memory and time must not grow with the table."""
    with open(tmp_path / "customers.csv", "wb") as f:
        f.truncate(60 << 20)
    paths = {"customers": str(tmp_path / "customers.csv")}
    assert Warehouse.from_csv(spark, paths, FIXTURE).buckets == 8
    monkeypatch.setattr(Warehouse, "MOST_BUCKETS", 5)
    assert Warehouse.from_csv(spark, paths, FIXTURE).buckets == 5


def test_one_row_per_customer_tables_merge_instead_of_being_broadcast(wh):
    """A small file can hold many rows, and a broadcast holds them all in every executor."""
    wide = model.wide_table(wh.staging_customers(), wh.staging_activity(), wh.holdings(), wh.cfg.product_names, HotKeys())
    assert any("SortMergeJoin" in x and "LeftOuter" in x for x in plan(wide).splitlines())
    seen = []
    original = model.rank_rows
    try:
        model.rank_rows = lambda df, *a, **k: seen.append(plan(df)) or original(df, *a, **k)
        model.fact_churn(wh.staging_activity(), wh.dim_customer(), wh.dim_product(), HotKeys())
    finally:
        model.rank_rows = original
    assert "SortMergeJoin" in seen[0]


def test_skew_join_equals_plain_join_and_broadcasts_hot_keys(spark):
    from churnkit.operators.joins import HotKeys, hot_keys, skew_join

    big = spark.range(0, 6000).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).when(F.col("id") % 7 == 0, F.lit(None))
        .otherwise(F.concat(F.lit("K"), (F.col("id") % 500).cast("string"))).alias("k"),
        F.col("id"))
    other = spark.range(0, 600).select(
        F.when(F.col("id") == 0, F.lit("HOT")).otherwise(F.concat(F.lit("K"), F.col("id").cast("string"))).alias("k"),
        (F.col("id") * 10).alias("w"))
    hot = hot_keys(big, "k", min_rows=1000)
    assert [k for k, _ in hot.rows] == ["HOT"]
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = skew_join(big, other, "k", how, hot)
        want = big.join(other, "k", how)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    p = plan(skew_join(big, other, "k", "inner", hot=HotKeys((("HOT", 4),))))
    assert "BroadcastHashJoin" in p and "Union" not in p


def test_dedupe_combines_before_the_shuffle(wh):
    """All rows meet one hash aggregate of the ids; only rows of repeated ids are ordered, the best of each task first."""
    p = plan(staging.dedupe_customers(wh.raw("customers"), wh.raw_hot("customers")))
    assert "partial_count" in p and "HashAggregate" in p and "SortAggregate" not in p
    assert p.count("WindowGroupLimit") == 2  # before the shuffle and after it


def test_rates_come_from_one_pass_over_the_base(wh):
    from churnkit.plans import staging as st
    from churnkit.operators import segments

    p = plan(segments.rate_sets(wh.base(), st.rate_keys()))
    assert p.count("FileScan parquet") == 1 and "Expand" in p


def test_counting_checks_read_nothing_after_the_load(wh):
    from churnkit.plans.queries import QUERIES

    for name in ("l_04_raw_row_counts", "dq_01_customer_rows", "dq_02_customer_nulls", "dq_06_future_join_dates", "dq_07_income_validity", "dq_08_null_account_status",
                 "dq_09_product_rows", "dq_11_null_product_status", "dq_12_open_before_inception", "dq_14_activity_rows", "dq_15_activity_nulls",
                 "dq_18_churn_date_integrity", "dq_19_credit_score_range"):
        assert "FileScan" not in plan(QUERIES[name](wh)), name
