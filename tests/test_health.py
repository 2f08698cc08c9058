import datetime as dt

import pytest

from ledgerlake.operators import health as h

ROLES = h.Roles(revenue=["rev"], cost=["cost"], time=["day"])
SCHEMA = "k string, seq int, rev double, cost double, day timestamp_ntz"


def ledger(spark, rows, roles=ROLES):
    return h.ledger(spark.createDataFrame(rows, SCHEMA), roles, ["k"], ["seq"])


def day(month, d=1, year=2024):
    return dt.datetime(year, month, d)


def months(k, revenue, cost=None, per_month=4):
    cost = cost or [0.0] * len(revenue)
    return [(k, 10 * i + j, r / per_month, c / per_month, day(i + 1, j + 1))
            for i, (r, c) in enumerate(zip(revenue, cost)) for j in range(per_month)]


def one(df):
    return {r.k: r for r in df.collect()}


def test_status_rules(spark):
    rows = (
        months("loss", [10, 10, 10], [20, 20, 20]) + months("costly", [100, 100, 100], [10, 10, 20])
        + months("thin", [100, 100, 100], [95, 95, 95]) + months("good", [100, 110, 120], [10, 10, 10])
        + [("none", 1, 0.0, 0.0, None)]
    )
    got = one(h.health(ledger(spark, rows), ["k"], ["seq"]))
    assert {k: r.status for k, r in got.items()} == {
        "loss": "Risk", "costly": "Warning", "thin": "Warning", "good": "Healthy", "none": "Warning"}
    assert got["costly"].reason == h.REASON_COST and got["thin"].reason == h.REASON_MARGIN
    assert got["none"].margin == 0.0 and got["none"].revenue_trend == "stable"
    assert got["good"].revenue_trend == "up" and got["good"].cost_trend == "stable"


@pytest.mark.parametrize("last, trend", [(105.0, "stable"), (105.1, "up"), (95.0, "stable"), (94.9, "down")])
def test_five_percent_is_stable(spark, last, trend):
    got = one(h.trends(ledger(spark, months("a", [100.0, 0.0, last])), ["k"], ["seq"]))
    assert got["a"].revenue_trend == trend


def test_ten_and_eleven_rows(spark):
    ten = [("ten", i, float(i), 1.0, day(1, i + 1)) for i in range(10)]
    eleven = [("eleven", i, float(i), 1.0, day(1 if i < 6 else 4, i + 1)) for i in range(11)]
    points = h.history(ledger(spark, ten + eleven), ["k"], ["seq"]).collect()
    assert sorted((r.back, r.period, r.revenue) for r in points if r.k == "ten") == [
        (0, "2024-01-10 00:00:00", 9.0), (1, "2024-01-09 00:00:00", 8.0), (2, "2024-01-08 00:00:00", 7.0)]
    # February and March have no rows and count as 0.
    assert sorted((r.back, r.period, r.revenue) for r in points if r.k == "eleven") == [
        (0, "2024-04-30", 40.0), (1, "2024-03-31", 0.0), (2, "2024-02-29", 0.0)]


def test_one_and_two_points(spark):
    rows = [("one", 1, 1.0, 0.0, day(1)), ("two", 1, 1.0, 0.0, day(1)), ("two", 2, 9.0, 0.0, day(2))]
    got = one(h.trends(ledger(spark, rows), ["k"], ["seq"]))
    assert (got["one"].n_points, got["one"].revenue_trend) == (1, "stable")
    assert (got["two"].n_points, got["two"].revenue_trend) == (2, "up")


def test_a_single_busy_month(spark):
    got = one(h.trends(ledger(spark, months("m", [100.0], per_month=20)), ["k"], ["seq"]))
    assert (got["m"].n_points, got["m"].revenue_trend) == (1, "stable")


def test_undated_rows_count_in_totals_only(spark):
    rows = months("a", [100.0, 100.0, 100.0], [10, 10, 10]) + [("a", 99, 1000.0, 0.0, None)]
    got = one(h.health(ledger(spark, rows), ["k"], ["seq"]))
    assert got["a"].revenue == 1300.0 and got["a"].revenue_trend == "stable"


def test_null_entity_keeps_its_trend(spark):
    rows = [(None, 1, 1.0, 0.0, day(1)), (None, 2, 9.0, 0.0, day(2)), ("b", 1, 5.0, 0.0, day(1))]
    got = one(h.health(ledger(spark, rows), ["k"], ["seq"]))
    assert got[None].revenue_trend == "up"


def test_totals_with_profit_columns_and_text_money(spark):
    df = spark.createDataFrame([("$1,000", "(200)", 5.0), ("n/a", "1-2", 7.0)], "rev string, cost string, net double")
    row = h.totals(h.ledger(df, h.Roles(revenue=["rev"], cost=["cost"], profit=["net"]), []), []).first()
    assert (row.revenue, row.cost, row.profit, row.margin) == (1000.0, 200.0, 12.0, 1.2)


def test_no_metric_roles(spark):
    with pytest.raises(ValueError, match="recognizable"):
        h.ledger(spark.range(1), h.roles_from_columns([("id", "identifier")]), [])


def test_report_and_long_form(spark):
    rows = ledger(spark, months("a", [1000.0, 1000.0, 1000.0], [10, 10, 10]))
    text = h.report(h.health(rows, ["k"], ["seq"])).first()
    assert text.figures.startswith("Total Revenue: 3,000.00 (Trend: stable)")
    assert text.summary == f"{h.REASON_GOOD} {h.ADVICE}"
    long = h.long_form(h.history(rows, ["k"], ["seq"]), ["k"]).collect()
    assert len(long) == 9 and {r.variable for r in long} == {"total_revenue", "total_cost", "total_profit"}


def test_sparse_entities_are_pruned_inside_each_task(spark):
    rows = ledger(spark, [("a", i, 1.0, 0.0, day(1)) for i in range(5)])
    plan = h._last_rows(rows, ["k"], ["seq"], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
