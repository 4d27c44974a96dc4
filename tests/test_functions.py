"""Column functions on hand-worked rows."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from footfall.functions import codes, dates, nulls
from footfall.functions.curves import logistic, year_grid

D = dt.date


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr("x")).collect()]


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


def test_month_round(spark):
    days = [D(2023, 4, 15), D(2023, 4, 16), D(2023, 5, 16), D(2023, 5, 17), D(2023, 2, 14), D(2023, 2, 15),
            D(2024, 2, 15), D(2024, 2, 16), D(2023, 12, 31), D(2023, 5, 1), None]
    assert column(spark, days, "DATE", dates.month_round) == [
        D(2023, 4, 1), D(2023, 5, 1), D(2023, 5, 1), D(2023, 6, 1), D(2023, 2, 1), D(2023, 3, 1),
        D(2024, 2, 1), D(2024, 3, 1), D(2024, 1, 1), D(2023, 5, 1), None]


def test_week_starts_on_sunday(spark):
    assert column(spark, [D(2023, 1, 4), D(2023, 1, 1), D(2023, 1, 7)], "DATE", dates.week_floor) == [D(2023, 1, 1)] * 3


def test_month_floor_is_a_date(spark):
    assert column(spark, [D(2023, 1, 31)], "DATE", dates.month_floor) == [D(2023, 1, 1)]


@pytest.mark.parametrize("forms,text,expected", [
    (dates.ISO, "2023-03-05", D(2023, 3, 5)),
    (dates.ISO, "2023/3/5", D(2023, 3, 5)),
    (dates.ISO, "2023-03-05 10:11:12", D(2023, 3, 5)),
    (dates.ISO, "2023-02-30", None),
    (dates.ISO, "2023", None),
    (dates.ISO, "x", None),
    (dates.ISO, "1/5/2023", None),
    (dates.ISO, None, None),
    (dates.US, "1/5/2023", D(2023, 1, 5)),
    (dates.US, "01/05/2023", D(2023, 1, 5)),
    (dates.US, "13/05/2023", None),
    (dates.YMD, "20230105", D(2023, 1, 5)),
    (dates.YMD, "2023-1-5", D(2023, 1, 5)),
    (dates.YMD, "2023/01/05", D(2023, 1, 5)),
    (dates.YMD, "202301051", None),
    (dates.YMD, "2020.01.02", D(2020, 1, 2)),
    (dates.YMD, "2020 1 2", D(2020, 1, 2)),
    (dates.YMD, "20-01-02", D(2020, 1, 2)),
    (dates.YMD, "69/1/2", D(1969, 1, 2)),
    (dates.YMD, "20-13-02", None),
])
def test_parse_date(spark, forms, text, expected):
    assert column(spark, [text], "STRING", lambda c: dates.parse_date(c, forms)) == [expected]


def test_parse_date_leaves_dates_alone(spark):
    assert column(spark, [D(2023, 3, 5)], "DATE", dates.parse_date) == [D(2023, 3, 5)]


def test_within_years_is_a_pushed_range(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.createDataFrame([(D(2022, 12, 31),), (D(2023, 1, 1),), (D(2023, 12, 31),), (D(2024, 1, 1),)], "d DATE") \
        .write.parquet(path)
    df = spark.read.parquet(path).filter(dates.within_years("d", 2023, 2023))
    assert sorted(r[0] for r in df.collect()) == [D(2023, 1, 1), D(2023, 12, 31)]
    assert "GreaterThanOrEqual(d" in df._jdf.queryExecution().executedPlan().toString()


def test_null_arithmetic(spark):
    n = F.lit(None).cast("double")
    assert one(spark, nulls.pmin(F.lit(1.0), n)) is None
    assert one(spark, nulls.pmin(F.lit(3.0), F.lit(2.0))) == 2.0
    assert one(spark, nulls.ratio(F.lit(0.0), F.lit(0.0))) is None
    assert one(spark, nulls.ratio(F.lit(1.0), F.lit(0.0))) is None
    two = spark.createDataFrame([(1.0, None)], "a DOUBLE, `b c` DOUBLE")
    assert two.select(nulls.row_sum(["a", "b c"])).first()[0] == 1.0
    assert two.select(nulls.plain_sum(["a", "b c"])).first()[0] is None
    assert two.select(nulls.weighted_sum(["a"], [3])).first()[0] == 3.0
    assert one(spark, nulls.is_in(n, [1.0])) is False
    assert one(spark, nulls.if_else(n > 1, 1, 0)) is None


def test_null_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None), ("c", 2.0), ("c", 2.0)], "k STRING, x DOUBLE")
    got = {r[0]: tuple(r)[1:] for r in df.groupBy("k").agg(
        nulls.sums_or_zero(["x"])[0], nulls.strict_sum("x"), nulls.n_distinct("x")).collect()}
    assert got == {"a": (1.0, None, 2), "b": (0.0, None, 1), "c": (4.0, 4.0, 1)}
    assert df.filter("k = 'z'").agg(nulls.n_distinct("x")).first()[0] == 0


def test_one_or_multi(spark):
    rows = [(1, "A"), (1, "A"), (2, "A"), (2, None), (3, None), (4, "A"), (4, "B")]
    df = spark.createDataFrame(rows, "k INT, r STRING").groupBy("k").agg(nulls.one_or_multi("r").alias("r"))
    assert dict(df.collect()) == {1: "A", 2: "Multi", 3: None, 4: "Multi"}


def test_first_by_puts_nulls_last(spark):
    df = spark.createDataFrame([(None, "x"), (2, "y"), (1, None), (1, "z")], "o INT, v STRING")
    assert df.agg(nulls.first_by("v", "o")).first()[0] == "z"
    assert df.filter("o IS NULL").agg(nulls.first_by("v", "o")).first()[0] == "x"


def test_education_codes(spark):
    labels = ["No Schooling", "Drop Out K-12", "HS/HiSET Graduate", "Unknown", "else", None]
    assert column(spark, labels, "STRING", lambda c: codes.code_of(c, codes.EDUCATION_1_9)) == [1, 4, 7, None, None, None]
    labels = ["No Schooling", "College 2 or 4 yr  Degree", "Unknown", "Not Selected", "else", None]
    assert column(spark, labels, "STRING", lambda c: codes.code_of(c, codes.EDUCATION_0_11)) == [2, 10, 0, 0, None, None]


def test_income_brackets(spark):
    values = [-5.0, 9999.99, 10000.0, 12000.0, 20000.0, 59999.0, 60000.0, 199999.0, 200000.0, None]
    assert column(spark, values, "DOUBLE", codes.bracket_number) == [1, 1, 2, 2, 4, 10, 11, 15, 16, None]
    assert column(spark, [5.0, None], "DOUBLE", codes.bracket_label) == ["income1", None]


def test_yes_flags(spark):
    assert column(spark, ["Yes", "yes", "No", None], "STRING", codes.yes_flag) == [1, 0, 0, None]
    assert column(spark, ["Yes", "yes", "No", None], "STRING", codes.yes_flag_any_case) == [1, 1, 0, None]


@pytest.mark.parametrize("k,r,x0,expected", [
    (30000, 0.3, 2021, {2018: 8671.515, 2021: 15000, 2024: 21328.485, 2026: 24527.234, 2028: 26727.095}),
    (36000, 0.15, 2024, {2018: 10405.818, 2024: 18000, 2028: 23243.627}),
    (42000, 0.3, 2025, {2018: 4582.066, 2025: 21000, 2028: 29859.879}),
    (37000, 0.15, 2024, {2018: 10694.868, 2024: 18500, 2028: 23889.283}),
])
def test_logistic_goldens(spark, k, r, x0, expected):
    df = spark.range(1).select(year_grid(2018, 2028).alias("year")).withColumn("p", logistic("year", k, r, x0))
    got = dict(df.collect())
    assert len(got) == 11
    for year, value in expected.items():
        assert math.isclose(got[year], value, abs_tol=1e-3)


@pytest.mark.parametrize("first,last", [
    ("2023-01-01", "2023-02-01"), ("2023-01-15", "2023-12-31"), (None, "2022-12-31"), ("2023-12-02", None), (None, None),
])
def test_within_months_equals_the_filter_on_month_starts(spark, first, last):
    df = spark.range(800).select(F.date_add(F.lit("2022-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    expected = {r[0] for r in df.filter(
        (dates.month_floor("d") >= F.lit(first or "0001-01-01").cast("date"))
        & (dates.month_floor("d") <= F.lit(last or "9999-01-01").cast("date"))).collect()}
    assert {r[0] for r in df.filter(dates.within_months("d", first, last)).collect()} == expected
