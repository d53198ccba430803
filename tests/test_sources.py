"""Raw CSV layer: exact round trip of blanks, quotes and NULLs; streaming load."""

import os

import pytest

from churnkit.session import scratch_path
from churnkit.sources.csv import MALFORMED, read_raw_csv, write_raw_csv
from churnkit.sources.schemas import RAW_PRODUCTS
from churnkit.streaming import load_counts, stream_raw_csv

ROWS = [
    ("C000000001", " CA", "2020-01-01", None),
    ("C000000002", "CREDIT CRD ", None, "Active"),
    ("C000000003", 'with "quote", comma', "1990-01-01", "Closed"),
    (None, "", "unknown", "Active"),
]


def test_csv_round_trip_is_exact(spark):
    path = scratch_path(spark, "csv-test")
    write_raw_csv(spark.createDataFrame(ROWS, RAW_PRODUCTS), path)
    back = read_raw_csv(spark, path, RAW_PRODUCTS)
    assert back.schema == RAW_PRODUCTS
    # an empty field, quoted or not, loads as NULL
    expected = [tuple(None if v == "" else v for v in r) for r in ROWS]
    assert sorted((tuple(r) for r in back.collect()), key=str) == sorted(expected, key=str)


def test_reader_keeps_malformed_values_as_strings(spark, tmp_path):
    p = tmp_path / "products.csv"
    p.write_text("customer_id,product_name,open_date,product_status\n"
                 "C1,Home Loan,not a date,Active\n"
                 "C2,,2020-01-01\n")
    rows = read_raw_csv(spark, str(p), RAW_PRODUCTS).collect()
    assert rows[0]["open_date"] == "not a date"
    assert rows[1]["product_name"] is None and rows[1]["product_status"] is None


def test_rows_of_the_wrong_shape_are_counted(spark, tmp_path):
    p = tmp_path / "products.csv"
    p.write_text("customer_id,product_name,open_date,product_status\n"
                 "C1,Home Loan,2020-01-01,Active\n"
                 "C2,Short\n"
                 "C3,Home Loan,2020-01-01,Active,extra\n"
                 'C4,"Home\nLoan",2020-01-01,Active\n')
    rows = read_raw_csv(spark, str(p), RAW_PRODUCTS, malformed=MALFORMED).cache()
    assert rows.count() == 5 and rows.filter(f"{MALFORMED} IS NOT NULL").count() == 4
    whole = read_raw_csv(spark, str(p), RAW_PRODUCTS, multi_line=True, malformed=MALFORMED).cache()
    assert {r["customer_id"] for r in whole.filter(f"{MALFORMED} IS NOT NULL").collect()} == {"C2", "C3"}
    assert whole.filter("customer_id = 'C4'").first()["product_name"] == "Home\nLoan"


def test_streaming_load_is_exactly_once(spark):
    src = scratch_path(spark, "stream-src")
    out = scratch_path(spark, "stream-out")
    ckpt = scratch_path(spark, "stream-ckpt")
    write_raw_csv(spark.createDataFrame(ROWS[:2], RAW_PRODUCTS).coalesce(1), f"{src}/day1")
    q = stream_raw_csv(spark, f"{src}/*", RAW_PRODUCTS, out, ckpt)
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 2
    write_raw_csv(spark.createDataFrame(ROWS[2:], RAW_PRODUCTS).coalesce(1), f"{src}/day2")
    q = stream_raw_csv(spark, f"{src}/*", RAW_PRODUCTS, out, ckpt)  # restart: only the new file
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 4


def test_streaming_load_counts_rows_of_the_wrong_shape(spark, tmp_path):
    (tmp_path / "src").mkdir()
    out, ckpt = scratch_path(spark, "stream-bad"), scratch_path(spark, "stream-bad-ckpt")
    head = "customer_id,product_name,open_date,product_status\n"
    days = ["C1,Home Loan,2020-01-01,Active\nC2,Short\n", "C3,Home Loan,2020-01-01,Active,extra\nC4,Home Loan,,\n"]
    for day, (text, want) in enumerate(zip(days, [(2, 1), (4, 2)])):
        (tmp_path / "src" / f"day{day}.csv").write_text(head + text)
        stream_raw_csv(spark, str(tmp_path / "src"), RAW_PRODUCTS, out, ckpt, malformed=MALFORMED).awaitTermination(120)
        assert tuple(load_counts(spark, out, MALFORMED).first()) == want
    batch = read_raw_csv(spark, str(tmp_path / "src"), RAW_PRODUCTS, malformed=MALFORMED).collect()
    assert sorted(map(str, batch)) == sorted(map(str, spark.read.parquet(out).collect()))


@pytest.mark.parametrize("table,count", [("customers", 1530), ("products", 2424), ("activity", 1510)])
def test_fixture_row_counts_sf001(spark, table, count):
    from churnkit.plans.warehouse import fixture_warehouse

    assert fixture_warehouse(spark, "/root/testdata/sf0.01").raw(table).count() == count


def test_publish_writes_every_finished_table(spark):
    from churnkit.plans.warehouse import fixture_warehouse

    wh = fixture_warehouse(spark, "/root/testdata/sf0.001")
    root = scratch_path(spark, "published")
    paths = wh.publish(root)
    assert set(paths) == {"staging.customers", "staging.products", "staging.activity", "staging.churn_analysis",
                          "staging.dim_customer", "staging.dim_product", "staging.dim_date", "staging.fact_churn"}
    assert spark.read.parquet(paths["staging.fact_churn"]).count() == wh.fact_churn().count()
    assert spark.read.parquet(paths["staging.dim_date"]).count() == 2557  # 1995-01-01 .. 2001-12-31
    wh.publish(root)  # a second run replaces the tables (full refresh)
    assert spark.read.parquet(paths["staging.customers"]).count() == wh.staging_customers().count()


def test_command_line_run_over_csv_exports(spark, capsys):
    from churnkit.__main__ import main
    from churnkit.plans.warehouse import Warehouse
    from churnkit.sources.sinks import read_published

    fx = Warehouse.from_fixtures(spark, "/root/testdata/sf0.001")  # writes the three CSV exports
    out = scratch_path(spark, "cli-out")
    assert main(["--customers", fx.raw_paths["customers"], "--products", fx.raw_paths["products"],
                 "--activity", fx.raw_paths["activity"], "--out", out,
                 "--reference-date", "2001-12-31", "--inception-date", "1995-01-01",
                 "--show", "eda_01_overall_rate"]) == 0
    assert "eda_01_overall_rate" in capsys.readouterr().out
    rate = spark.read.parquet(f"{out}/reports/eda_01_overall_rate").first()
    assert rate["total_customers"] == read_published(spark, out, "staging.churn_analysis").count()
    counts = [r["count"] for r in spark.read.parquet(f"{out}/reports/dq_10_product_variants").collect()]
    assert len(counts) > 1 and counts == sorted(counts, reverse=True)
    log = spark.read.parquet(f"{out}/reports/dq_00_quality_log")
    assert log.filter("check_id = 'DQ-13'").first()["severity"] == "Critical"


def test_every_query_runs_on_empty_exports(spark):
    from churnkit.config import BANK
    from churnkit.plans.queries import QUERIES
    from churnkit.plans.warehouse import Warehouse
    from churnkit.sources.schemas import RAW_SCHEMAS

    root = scratch_path(spark, "empty")
    paths = {}
    for name, schema in RAW_SCHEMAS.items():
        paths[name] = f"{root}/{name}"
        write_raw_csv(spark.createDataFrame([], schema), paths[name])
    wh = Warehouse.from_csv(spark, paths, BANK)
    counts = {name: fn(wh).count() for name, fn in QUERIES.items()}
    assert counts["st_11_staging_customers"] == 0 and counts["ss_4_fact_churn"] == 0
    assert counts["eda_01_overall_rate"] == 1  # a global aggregate over no rows is one row
    assert counts["eda_26_balance_deciles"] == 0
    assert counts["eda_27_outlier_sensitivity"] == 2


def test_a_publish_that_fails_half_way_leaves_the_old_set(spark, tmp_path):
    from churnkit.sources.sinks import manifest, publish_tables, read_published

    root = str(tmp_path / "published")

    def both(n):
        return {name: lambda n=n: spark.range(n) for name in ("a", "b")}

    def fails():
        raise RuntimeError("half way")

    assert manifest(spark, root) is None
    publish_tables(spark, both(3), root)
    before = manifest(spark, root)
    with pytest.raises(RuntimeError):
        publish_tables(spark, both(5) | {"b": fails}, root)
    assert manifest(spark, root) == before
    assert [read_published(spark, root, n).count() for n in ("a", "b")] == [3, 3]
    for n in (6, 7, 8):
        publish_tables(spark, both(n), root)
        assert [read_published(spark, root, t).count() for t in ("a", "b")] == [n, n]
    assert len(list((tmp_path / "published" / "versions").iterdir())) == 2  # the current one and the one before it


def test_close_leaves_no_table_or_layer_behind(spark):
    from churnkit.config import FIXTURE
    from churnkit.plans.warehouse import Warehouse, fixture_warehouse

    other = fixture_warehouse(spark, "/root/testdata/sf0.001").staging_customers()
    wh = Warehouse.from_fixtures(spark, "/root/testdata/sf0.001", FIXTURE)
    wh.dim_customer()
    tables, folders = list(wh._made.tables), [f.removeprefix("file:") for f in wh._made.folders]
    assert tables and all(spark.catalog.tableExists(t) for t in tables) and all(os.path.exists(f) for f in folders)
    wh.close()
    assert not any(spark.catalog.tableExists(t) for t in tables)
    assert not any(os.path.exists(f) for f in folders)
    assert other.count() > 0  # another warehouse's layers stay
