"""The distributed ordering helper against Spark's single-task windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from churnkit.operators import ordering
from churnkit.operators.ordering import ntile, percentile_exact, rank_rows


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        v = None if i % 11 == 0 else float(rnd.randint(0, 40))  # many ties and NULLs
        g = ["a", "b", "c", None][i % 4]
        rows.append((i, g, v))
    return spark.createDataFrame(rows, "id long, g string, v double").repartition(5)


def _compare(df, got_col, ref_col):
    bad = df.filter(~F.col(got_col).eqNullSafe(F.col(ref_col))).count()
    return bad, df.count()


def test_row_number_desc_nulls_last(data):
    order = [F.col("v").desc_nulls_last(), F.col("id").asc()]
    got = rank_rows(data, order, name="rn")
    ref = data.withColumn("rn2", F.row_number().over(Window.orderBy(*order)))
    bad, n = _compare(got.join(ref.select("id", "rn2"), "id"), "rn", "rn2")
    assert (bad, n) == (0, 3000)


def test_row_number_within_groups_including_null_group(data):
    order = [F.col("v").asc_nulls_first(), F.col("id").asc()]
    got = rank_rows(data, order, by=["g"], name="rn")
    ref = data.withColumn("rn2", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    bad, n = _compare(got.join(ref.select("id", "rn2"), "id"), "rn", "rn2")
    assert (bad, n) == (0, 3000)


@pytest.mark.parametrize("k", [1, 3, 10, 7000])
def test_ntile_matches_sql_ntile(data, k):
    order = [F.col("v").desc_nulls_last(), F.col("id").asc()]
    got = ntile(data, k, order, name="t")
    ref = data.withColumn("t2", F.ntile(k).over(Window.orderBy(*order)))
    bad, n = _compare(got.join(ref.select("id", "t2"), "id"), "t", "t2")
    assert (bad, n) == (0, 3000)


def test_ntile_fewer_rows_than_tiles(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(7)], "id long, v double")
    got = sorted((r["id"], r["t"]) for r in ntile(df, 10, [F.col("v").desc()], name="t").collect())
    assert got == [(i, 7 - i) for i in range(7)]


@pytest.mark.parametrize("k", [1, 4, 10])
def test_ntile_sums_match_a_plain_window(spark, k):
    """A third of the values equal, a tenth NULL: edges fall inside ties and among the NULLs."""
    df = spark.range(5000).select("id", F.when(F.col("id") % 10 == 3, None).when(F.col("id") % 3 == 0, 7.0)
                                  .otherwise(((F.col("id") * 7919) % 5003 - 900) / 8).cast("double").alias("v"))
    got = {r["tile"]: (r["n"], r["total"]) for r in ordering.ntile_sums(df, "v", "id", k).collect()}
    order = Window.orderBy(F.col("v").desc_nulls_last(), "id")
    ref = df.withColumn("t", F.ntile(k).over(order)).groupBy("t").agg(F.count("id").alias("n"), F.sum("v").alias("s"))
    assert got == {r["t"]: (r["n"], r["s"]) for r in ref.collect()}


def test_ntile_sums_of_few_or_no_rows(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 6.0)], "id long, v double")
    got = sorted((r["tile"], r["n"], r["total"]) for r in ordering.ntile_sums(df, "v", "id", 10).collect())
    assert got == [(1, 1, 6.0), (2, 1, 5.0), (3, 1, None)]
    assert ordering.ntile_sums(df.filter("id > 3"), "v", "id", 10).count() == 0


def test_ntile_sums_rank_only_rows_near_an_edge(spark, monkeypatch):
    ranked = []
    real = ordering.rank_rows
    monkeypatch.setattr(ordering, "rank_rows", lambda d, *a, **k: ranked.append(d.count()) or real(d, *a, **k))
    df = spark.range(1_000_000).select("id", F.xxhash64("id").cast("double").alias("v"))
    assert ordering.ntile_sums(df, "v", "id", 10).agg(F.sum("n")).first()[0] == 1_000_000
    assert sum(ranked) < 2_000


def test_empty_input(spark):
    df = spark.createDataFrame([], "id long, v double")
    assert rank_rows(df, [F.col("v")]).count() == 0
    assert ntile(df, 10, [F.col("v")]).count() == 0
    assert percentile_exact(df, "v", 0.5).count() == 0


@pytest.mark.parametrize("p", [0.0, 0.123, 0.5, 0.99, 1.0])
def test_percentile_matches_percentile_aggregate(data, p):
    got = percentile_exact(data, "v", p).first()["percentile"]
    ref = data.agg(F.percentile("v", p)).first()[0]
    assert got == pytest.approx(ref, rel=1e-12)


def test_grouped_percentile(data):
    got = {r["g"]: r["m"] for r in percentile_exact(data, "v", 0.5, by=["g"], name="m").collect()}
    ref = {r["g"]: r["m"] for r in data.groupBy("g").agg(F.percentile("v", 0.5).alias("m")).collect()}
    assert got.keys() == ref.keys()
    for k in ref:
        assert got[k] == pytest.approx(ref[k])


def test_hot_key_is_spread_over_partitions(spark):
    """One value holding half of the rows is still split across sorted ranges."""
    rows = [(i, 5.0 if i % 2 == 0 else float(i)) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, v double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = rank_rows(df, [F.col("v").asc()], name="rn")
        sizes = ranked.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert ranked.agg(F.countDistinct("rn"), F.min("rn"), F.max("rn")).first() == (4000, 1, 4000)
    assert max(r["count"] for r in sizes) < 4000 * 0.5


def test_same_numbers_on_every_evaluation_of_a_stored_input(spark):
    """Ties are broken by scan position, so recomputation gives the same numbering."""
    from churnkit.session import materialize

    df = materialize(spark.range(0, 2000).select(F.col("id"), (F.col("id") % 3).alias("v")), "det")
    first = rank_rows(df, [F.col("v")], name="rn", stable_input=True)
    second = rank_rows(df, [F.col("v")], name="rn", stable_input=True)
    a = {r["id"]: r["rn"] for r in first.collect()}
    b = {r["id"]: r["rn"] for r in second.collect()}
    assert a == b and sorted(a.values()) == list(range(1, 2001))


def test_band_path_is_used_and_exact(spark, data, monkeypatch):

    def no_sort(*a, **k):
        raise AssertionError("fell back to the full sort")

    monkeypatch.setattr(ordering, "percentile_by_sort", no_sort)
    for p in (0.0, 0.37, 0.5, 0.99, 1.0):
        got = ordering.percentile_exact(data, "v", p).first()["percentile"]
        assert got == pytest.approx(data.agg(F.percentile("v", p)).first()[0], rel=1e-12)
    got = {r["g"]: r["m"] for r in ordering.percentile_exact(data, "v", 0.5, by=["g"], name="m").collect()}
    ref = {r["g"]: r["m"] for r in data.groupBy("g").agg(F.percentile("v", 0.5).alias("m")).collect()}
    assert got == pytest.approx(ref)


def test_band_miss_falls_back_to_the_sort(spark, monkeypatch):

    rows = [(float(i * 7 % 1001),) for i in range(5000)]
    df = spark.createDataFrame(rows, "v double")
    monkeypatch.setattr(ordering, "BAND_ACCURACY", 10)
    monkeypatch.setattr(ordering, "BAND_WIDTHS", (0.0,))
    sorted_groups = []
    by_sort = ordering.percentile_by_sort
    monkeypatch.setattr(ordering, "percentile_by_sort", lambda d, *a, **k: sorted_groups.append(d) or by_sort(d, *a, **k))
    got = ordering.percentile_exact(df, "v", 0.5).first()[0]
    assert got == df.agg(F.percentile("v", 0.5)).first()[0] and len(sorted_groups) == 1


def test_small_and_large_groups_both_use_the_band(spark, monkeypatch):

    def no_sort(*a, **k):
        raise AssertionError("a group was sorted whole")

    monkeypatch.setattr(ordering, "percentile_by_sort", no_sort)
    df = spark.range(201_479).select(
        F.when(F.col("id") < 200_000, "large").when(F.col("id") < 201_476, "small").otherwise("tiny").alias("g"),
        ((F.col("id") * 7919) % 100_003).cast("double").alias("v"))
    got = {r["g"]: r["m"] for r in ordering.percentile_exact(df, "v", 0.99, by=["g"], name="m").collect()}
    ref = {r["g"]: r["m"] for r in df.groupBy("g").agg(F.percentile("v", 0.99).alias("m")).collect()}
    assert got == pytest.approx(ref)


def test_percentile_inside_a_hot_value(spark, monkeypatch):

    rows = [(i, 50.0) for i in range(2000)] + [(i, float(i % 97)) for i in range(2000, 5000)]
    df = spark.createDataFrame(rows, "id long, v double")
    for p in (0.3, 0.5, 0.9):
        assert ordering.percentile_exact(df, "v", p).first()[0] == pytest.approx(
            df.agg(F.percentile("v", p)).first()[0])


def test_weighted_running_sum_matches_a_window(spark):
    from churnkit.operators.ordering import weighted_running_sum

    rows = [(["a", "b", None][i % 3], float(i % 37), (i * 7) % 5 + 1) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v double, w int")
    got = weighted_running_sum(df, [F.col("v").asc()], "w", by=["g"], name="c")
    # distinct (g, v) pairs are not unique here, so compare per (g, v): the running sum after the last tie
    last = got.groupBy("g", "v").agg(F.max("c").alias("c"))
    ref = (df.groupBy("g", "v").agg(F.sum("w").alias("w"))
           .withColumn("c", F.sum("w").over(Window.partitionBy("g").orderBy("v"))).select("g", "v", "c"))
    got_rows = sorted(map(tuple, last.collect()), key=str)
    ref_rows = sorted(map(tuple, ref.collect()), key=str)
    assert got_rows == ref_rows


def test_band_path_at_three_million_values(spark, monkeypatch):
    """Above the size switch the band path runs unforced, and stays exact."""
    from churnkit.session import materialize

    def no_sort(*a, **k):
        raise AssertionError("fell back to the full sort")

    monkeypatch.setattr(ordering, "percentile_by_sort", no_sort)
    df = materialize(spark.range(0, 3_000_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 5).cast("string")).alias("g"),
        ((F.col("id") * 7919) % 100_003 / 7.0).alias("v")), "band-3m")
    for p in (0.5, 0.99):
        got = ordering.percentile_exact(df, "v", p, stable_input=True).first()[0]
        assert got == pytest.approx(df.agg(F.percentile("v", p)).first()[0], rel=1e-12)
    got = {r["g"]: r["m"] for r in ordering.percentile_exact(df, "v", 0.5, by=["g"], name="m",
                                                              stable_input=True).collect()}
    ref = {r["g"]: r["m"] for r in df.groupBy("g").agg(F.percentile("v", 0.5).alias("m")).collect()}
    assert got == pytest.approx(ref, rel=1e-12)
