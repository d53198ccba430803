"""Column functions: guarded parsing, mapping, bands, calendar rules."""

import datetime as dt

from pyspark.sql import functions as F

from churnkit import config as C
from churnkit.functions import (
    band,
    date_key,
    map_values,
    pct,
    range_band,
    to_date,
    to_flag,
    to_float,
    to_int,
    to_int_via_float,
    week_of_year_sunday,
    weekday_number,
    year_diff,
)


def one(spark, expr, value, typ="string"):
    df = spark.createDataFrame([(value,)], f"v {typ}")
    return df.select(expr(F.col("v")).alias("r")).first()["r"]


def test_to_float_rejects_spark_only_forms(spark):
    assert one(spark, to_float, "518.0") == 518.0
    assert one(spark, to_float, " -12.5 ") == -12.5
    assert one(spark, to_float, "1e3") == 1000.0
    for bad in ("NaN", "Infinity", "1.5d", "2f", "n/a", "", None):
        assert one(spark, to_float, bad) is None


def test_two_step_integer_parse(spark):
    assert one(spark, to_int_via_float, "518.0") == 518
    assert one(spark, to_int_via_float, "518.9") == 518  # truncation, not rounding
    assert one(spark, to_int_via_float, "-3.7") == -3
    assert one(spark, to_int_via_float, "99999999999.0") is None  # out of int range
    assert one(spark, to_int, "518.0") is None  # a direct integer parse fails on decimals
    assert one(spark, to_int, " 12 ") == 12


def test_flag_parse(spark):
    assert [one(spark, to_flag, v) for v in ("1", "0", "2", "true", "FALSE", "Y", None, "00")] == [
        1, 0, 1, 1, 0, None, None, 0]


def test_date_parse_year_first(spark):
    forms = ["2024-01-15", " 2024-1-15 ", "2024/01/15", "20240115", "2024-01-15 00:00:00", "2024-01-15T10:00:00", "2024-01-15 23:59:59.9999999", "20240115 08:30"]
    bad = ["unknown", "", "2024", "240115", "2024-02-30", "20240230", "15/01/2024", "2024-01/15", "2024-01-15 24:00", "2024-01-15 x", "2024-01-1500:00", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(forms + bad)], "i int, v string")
    got = [r["d"] for r in df.select("i", to_date("v").alias("d")).orderBy("i").collect()]
    assert got == [dt.date(2024, 1, 15)] * len(forms) + [None] * len(bad)


def test_date_parse_named_formats(spark):
    def day_first(c):
        return to_date(c, formats=("dd/MM/yyyy", "dd MMM yyyy"))

    assert [one(spark, day_first, v) for v in ("15/01/2024", "15 Jan 2024", "2024-01-15")] == [dt.date(2024, 1, 15)] * 3
    for bad in ("01/15/2024", "31/02/2024", "x", None):
        assert one(spark, day_first, bad) is None


def test_map_values_first_match_and_default(spark):
    df = spark.createDataFrame([(" gp ",), ("KZN",), ("Gauteng",), ("nowhere",), (None,)], "p string")
    out = [r[0] for r in df.select(map_values("p", C.PROVINCE_VARIANTS, C.UNKNOWN)).collect()]
    assert out == ["Gauteng", "KwaZulu-Natal", "Gauteng", "Unknown", "Unknown"]
    keep = [r[0] for r in df.select(map_values("p", {"X": ("KZN",)}, F.col("p"))).collect()]
    assert keep == [" gp ", "X", "Gauteng", "nowhere", None]


def test_band_null_falls_to_top_unless_labelled(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (9999.99,), (10000.0,), (250000.0,)], "b double")
    tiers = [r[0] for r in df.select(band("b", C.BALANCE_TIERS, C.BALANCE_TOP)).collect()]
    assert tiers == ["R200,000 & above", "Overdrawn", "R0 - R9,999", "R10,000 - R49,999", "R200,000 & above"]
    labelled = df.select(band("b", C.BALANCE_TIERS, C.BALANCE_TOP, null_label="Unknown")).first()[0]
    assert labelled == "Unknown"


def test_age_bands_inclusive_and_over_65(spark):
    df = spark.createDataFrame([(17,), (18,), (25,), (65,), (66,), (None,)], "a int")
    out = [r[0] for r in df.select(range_band("a", C.AGE_RANGES, C.AGE_ABOVE, "Unknown", "Unknown")).collect()]
    assert out == ["Unknown", "18-25", "18-25", "56-65", "65+", "Unknown"]


def test_calendar_year_difference_ignores_day(spark):
    df = spark.createDataFrame([(dt.date(2000, 12, 31), dt.date(2024, 1, 1))], "a date, b date")
    assert df.select(year_diff("a", "b")).first()[0] == 24


def test_week_number_sunday_start(spark):
    days = [dt.date(2016, 12, 31), dt.date(2016, 1, 1), dt.date(2016, 1, 3), dt.date(2017, 1, 1),
            dt.date(2015, 1, 3), dt.date(2015, 1, 4)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = [r[0] for r in df.select(week_of_year_sunday("d")).collect()]
    # week 1 holds 1 January; a new week starts each Sunday
    expected = []
    for d in days:
        jan1 = dt.date(d.year, 1, 1)
        jan1_sun1 = (jan1.isoweekday() % 7) + 1  # Sunday = 1
        expected.append((d.timetuple().tm_yday + jan1_sun1 - 2) // 7 + 1)
    assert got == expected
    assert got[0] == 53
    assert [r[0] for r in df.select(weekday_number("d")).collect()] == [(d.isoweekday() % 7) + 1 for d in days]
    assert df.select(date_key("d")).first()[0] == 20161231


def test_pct_rounding_and_zero_denominator(spark):
    df = spark.createDataFrame([(1, 3), (2, 0), (1, 8)], "c long, n long")
    assert [r[0] for r in df.select(pct("c", "n")).collect()] == [33.33, None, 12.5]


def test_date_dimension_against_python_calendar(spark):
    import calendar

    from churnkit.operators.model import date_dimension

    rows = {r["full_date"]: r for r in date_dimension(spark, "2015-01-01", "2024-12-31").collect()}
    day, end = dt.date(2015, 1, 1), dt.date(2024, 12, 31)
    assert len(rows) == (end - day).days + 1 == 3653
    while day <= end:
        r = rows[day]
        sunday1 = (day.isoweekday() % 7) + 1
        jan1 = (dt.date(day.year, 1, 1).isoweekday() % 7) + 1
        q = (day.month - 1) // 3 + 1
        assert r["date_key"] == day.year * 10000 + day.month * 100 + day.day
        assert (r["year"], r["month_number"], r["quarter"], r["day_of_month"]) == (day.year, day.month, q, day.day)
        assert r["month_name"] == calendar.month_name[day.month]
        assert r["day_of_week_name"] == calendar.day_name[day.weekday()]
        assert r["quarter_label"] == f"Q{q} {day.year}" and r["year_month"] == f"{day.year}-{day.month:02d}"
        assert r["week_number"] == (day.timetuple().tm_yday + jan1 - 2) // 7 + 1
        assert r["day_of_week_number"] == sunday1
        assert r["is_weekend"] == (1 if sunday1 in (1, 7) else 0)
        last = calendar.monthrange(day.year, day.month)[1]
        assert r["is_month_end"] == (1 if day.day == last else 0)
        day += dt.timedelta(days=1)
