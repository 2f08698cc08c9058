import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import metrics as m
from ledgerlake.operators.catalog import preview, union_tables
from ledgerlake.operators.policy import guarded_agg


@pytest.fixture
def sales(spark):
    return spark.createDataFrame(
        [("a", "2024", Decimal("10.00"), Decimal("4.00")), ("a", "2025", Decimal("5.00"), Decimal("1.00")),
         ("b", "2024", Decimal("0.00"), Decimal("3.00"))],
        "k string, year string, revenue decimal(18,2), cost decimal(18,2)")


def as_dict(df, key="k"):
    return {r[key]: {c: (float(r[c]) if isinstance(r[c], Decimal) else r[c]) for c in df.columns if c != key} for r in df.collect()}


def test_margin_and_ratios(sales):
    assert as_dict(m.margin(sales, "revenue", "cost", ["k"])) == {
        "a": {"total_revenue": 15.0, "total_cost": 5.0, "profit": 10.0, "margin_pct": 66.67},
        "b": {"total_revenue": 0.0, "total_cost": 3.0, "profit": -3.0, "margin_pct": None}}
    assert as_dict(m.ratio(sales, "cost", "revenue", ["k"])) == {"a": {"ratio": 0.3333}, "b": {"ratio": None}}
    assert as_dict(m.per_unit(sales, "cost", "revenue", ["k"])) == {"a": {"per_unit": 0.33}, "b": {"per_unit": None}}
    assert as_dict(m.net(sales, "revenue", "cost", ["k"])) == {"a": {"net": 10.0}, "b": {"net": -3.0}}


def test_spread_of_one_row_is_null(sales):
    got = as_dict(m.spread(sales, "revenue", ["k"]))
    assert got["b"] == {"stddev": None, "variance": None} and got["a"]["variance"] == 12.5


def test_growth(sales):
    rows = sorted((r.k, r.year, r.previous, r.change_pct) for r in m.growth_rate(sales, "revenue", "year", ["k"]).collect())
    assert rows == [("a", "2024", None, None), ("a", "2025", Decimal("10.00"), -50.0), ("b", "2024", None, None)]


@pytest.mark.parametrize("limit", [1, 1000])
def test_running_total_shares_peers(spark, limit):
    spark.conf.set("ledgerlake.ordered.blockRows", str(limit))
    try:
        df = spark.createDataFrame([(1, "d1", 1), (2, "d2", 2), (3, "d2", 3), (4, "d3", 4)], "i int, d string, v int")
        got = {r.i: r.running_total for r in m.with_running_total(df, "v", "d").collect()}
    finally:
        spark.conf.unset("ledgerlake.ordered.blockRows")
    assert got == {1: 1, 2: 6, 3: 6, 4: 10}


def test_share_of_total(spark):
    few = spark.createDataFrame([("a", 1), ("b", 3)], "c string, v int")
    assert {r.c: (r.share_pct, r.pie_fits) for r in m.share_of_total(few, "c", "v").collect()} == {"a": (25.0, True), "b": (75.0, True)}
    many = spark.createDataFrame([(str(i), 1) for i in range(8)], "c string, v int")
    assert {(r.share_pct, r.pie_fits) for r in m.share_of_total(many, "c", "v").collect()} == {(12.5, False)}


def test_chart_data(spark):
    df = spark.createDataFrame(
        [(c, v, dt.datetime(2024, 1, i + 1)) for i, (c, v) in enumerate(zip("ABCD", (10, 20, 30, 40)))],
        "category string, value int, date timestamp")
    assert m.chart_spec(df) == m.ChartSpec("date", "value", "line")
    assert [r.y for r in m.chart_data(df).collect()] == [10, 20, 30, 40]
    bars = df.drop("date")
    assert m.chart_spec(bars) == m.ChartSpec("category", "value", "bar")
    assert m.chart_spec(bars.select("value")) is None and m.chart_data(bars.select("category")) is None
    assert not m.valid_spec(df, m.ChartSpec("nope", "value", "bar"))
    assert m.chart_data(df, m.ChartSpec("nope", "value", "bar")) is None


def test_preview_and_union(spark):
    df = spark.range(12)
    assert [(r.id, r.more_rows) for r in preview(df, ["id"], 3).collect()] == [(0, 9), (1, 9), (2, 9)]
    both = union_tables([spark.createDataFrame([(1, "a")], "x int, y string"), spark.createDataFrame([(2,)], "x int")])
    assert sorted(map(tuple, both.collect())) == [(1, "a"), (2, None)]


def test_guarded_aggregates(spark):
    df = spark.range(10).withColumn("k", F.col("id") % 2)
    assert sorted(map(tuple, guarded_agg(df, ["k"], {"n": ("count", "id"), "top": ("max", "id")}, True, False).collect())) == [(0, 5, 8), (1, 5, 9)]
    with pytest.raises(PermissionError):
        guarded_agg(df, ["k"], {"n": ("count", "id")}, False, False)
    for aggs in ({}, {"rows": ("collect_list", "id")}, {"n": ("count", "id"), "x": ("array_agg", "id")}):
        with pytest.raises(PermissionError):
            guarded_agg(df, ["k"], aggs, True, False)
