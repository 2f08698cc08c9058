import datetime as dt

from pyspark.sql import functions as F

from ledgerlake.functions import clean


def test_numbers(spark):
    values = ["$1,234.50", "(500)", "1-2", "", None, "-3.5", "abc", "5.", ".", "1.2.3", "1e+16"]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    got = [r.x for r in df.select("i", clean.clean_number(F.col("v")).alias("x")).orderBy("i").collect()]
    assert got == [1234.5, 500.0, 0.0, 0.0, 0.0, -3.5, 0.0, 5.0, 0.0, 0.0, 116.0]


def test_numeric_columns_pass_through(spark):
    df = spark.createDataFrame([(1e16,), (1e-5,), (None,)], "v double")
    assert [r.x for r in df.select(clean.metric_value(df, "v").alias("x")).collect()] == [1e16, 1e-5, 0.0]


def test_dates(spark):
    values = ["2024-01-05", "1/2/2024", "Mar 3, 2024", "4 Apr 2024", "2024/5/6", "2024", "2024-01-05 10:11:12", "soon", None]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    got = [r.x for r in df.select("i", clean.clean_date(F.col("v")).alias("x")).orderBy("i").collect()]
    assert got == [dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 2), dt.datetime(2024, 3, 3), dt.datetime(2024, 4, 4),
                   dt.datetime(2024, 5, 6), dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 5, 10, 11, 12), None, None]


def test_whole_number_years(spark):
    df = spark.createDataFrame([(2023,)], "year int")
    assert df.select(clean.time_value(df, "year").alias("x")).first().x == dt.datetime(2023, 1, 1)


def test_drop_empty(spark):
    df = spark.createDataFrame([(None, None, "a"), (None, None, None), (1, None, None)], "x int, y string, z string")
    out = clean.drop_empty(df)
    assert out.columns == ["x", "z"]
    assert sorted(map(tuple, out.collect()), key=str) == [(1, None), (None, "a")]


def test_nan_and_nul(spark):
    df = spark.createDataFrame([(float("nan"), "a\x00b"), (1.5, "c")], "x double, t string")
    got = clean.nan_to_null(df).select("x", clean.strip_nul(F.col("t")).alias("t")).collect()
    assert [tuple(r) for r in got] == [(None, "ab"), (1.5, "c")]
