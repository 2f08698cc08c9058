"""Business-health queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import health as h
from .registry import query
from .views import oracle, view

ROLES = h.Roles(revenue=["revenue"], cost=["cost"], time=["ts"])
ORDER = ["seq", "tie"]


def _rows(spark: SparkSession, d: str, key: str) -> DataFrame:
    return h.ledger(view(spark, d, "ledger_v"), ROLES, [key], ORDER)


def _double(df: DataFrame) -> DataFrame:
    return df.withColumns({m: F.col(m).cast("double") for m in h.METRICS})


def _points_sql(key: str) -> str:
    """CTEs up to ``points``: the last three points of every entity, computed month by month."""
    return f"""
WITH rows_all AS (SELECT {key} AS k, ts, seq, tie, revenue, cost, revenue - cost AS profit FROM ledger_v),
sums AS (SELECT k, SUM(revenue) AS revenue, SUM(cost) AS cost, SUM(profit) AS profit, COUNT(ts) AS n_dated
  FROM rows_all GROUP BY 1),
months AS (SELECT k, date_trunc('month', ts) AS mon, SUM(revenue) AS revenue, SUM(cost) AS cost, SUM(profit) AS profit
  FROM rows_all WHERE ts IS NOT NULL GROUP BY 1, 2),
ends AS (SELECT k, MIN(mon) AS lo, MAX(mon) AS hi FROM months GROUP BY 1),
calendar AS (SELECT k, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS mon FROM ends),
filled AS (SELECT c.k, c.mon, COALESCE(m.revenue, 0) AS revenue, COALESCE(m.cost, 0) AS cost, COALESCE(m.profit, 0) AS profit,
    ROW_NUMBER() OVER (PARTITION BY c.k ORDER BY c.mon DESC) - 1 AS back
  FROM calendar c LEFT JOIN months m ON m.k = c.k AND CAST(m.mon AS DATE) = c.mon),
singles AS (SELECT k, ts, revenue, cost, profit, ROW_NUMBER() OVER (PARTITION BY k ORDER BY ts DESC, seq DESC, tie DESC) - 1 AS back
  FROM rows_all WHERE ts IS NOT NULL),
points AS (
  SELECT f.k, f.back, CAST(last_day(f.mon) AS VARCHAR) AS period, f.revenue, f.cost, f.profit
  FROM filled f JOIN sums s ON s.k = f.k WHERE s.n_dated > 10 AND f.back < 3
  UNION ALL
  SELECT g.k, g.back, CAST(g.ts AS VARCHAR), g.revenue, g.cost, g.profit
  FROM singles g JOIN sums s ON s.k = g.k WHERE s.n_dated <= 10 AND g.back < 3)"""


def _trend_sql(x: str) -> str:
    first, last = f"CAST(arg_max({x}, back) AS DOUBLE)", f"CAST(arg_min({x}, back) AS DOUBLE)"
    change = f"({last} - {first}) / (abs({first}) + 1e-9)"
    return (f"CASE WHEN COUNT(*) < 2 THEN 'stable' WHEN {change} > 0.05 THEN 'up' "
            f"WHEN {change} < -0.05 THEN 'down' ELSE 'stable' END AS {x}_trend")


_TRENDS = """,
trends AS (SELECT k, COUNT(*) AS n_points, """ + ", ".join(_trend_sql(x) for x in h.METRICS) + """
  FROM points GROUP BY 1)"""

_STATUS = """,
judged AS (SELECT s.k, CAST(s.revenue AS DOUBLE) AS revenue, CAST(s.cost AS DOUBLE) AS cost, CAST(s.profit AS DOUBLE) AS profit,
  CASE WHEN s.revenue <> 0 THEN ROUND(CAST(s.profit AS DOUBLE) / CAST(s.revenue AS DOUBLE) * 100, 2) ELSE 0 END AS margin,
  t.revenue_trend, t.cost_trend, t.profit_trend FROM sums s JOIN trends t ON t.k = s.k),
final AS (SELECT *, CASE WHEN profit < 0 THEN 'Risk'
    WHEN cost_trend = 'up' AND revenue_trend <> 'up' THEN 'Warning' WHEN margin < 10 THEN 'Warning' ELSE 'Healthy' END AS status,
  CASE WHEN profit < 0 THEN 'The business is currently operating at a net loss.'
    WHEN cost_trend = 'up' AND revenue_trend <> 'up' THEN 'Expenses are rising faster than revenue, threatening future margins.'
    WHEN margin < 10 THEN 'Profit margins are low, indicating potential sensitivity to cost changes.'
    ELSE 'The business shows positive profit margins and stable or improving trends.' END AS reason FROM judged)"""


def _health(spark: SparkSession, d: str, key: str) -> DataFrame:
    return _double(h.health(_rows(spark, d, key), [key], ORDER).withColumnRenamed(key, "k"))


@query("health_by_key", oracle("ledger_v", body=_points_sql("k") + _TRENDS + _STATUS + " SELECT * FROM final"))
def health_by_key(spark: SparkSession, d: str) -> DataFrame:
    return _health(spark, d, "k")


@query("health_by_small_key",
       oracle("ledger_v", body=_points_sql("k_small") + _TRENDS + _STATUS + " SELECT * FROM final"))
def health_by_small_key(spark: SparkSession, d: str) -> DataFrame:
    return _health(spark, d, "k_small")


@query("health_totals", oracle("ledger_v", body="""
SELECT CAST(SUM(revenue) AS DOUBLE) AS revenue, CAST(SUM(cost) AS DOUBLE) AS cost,
  CAST(SUM(revenue - cost) AS DOUBLE) AS profit,
  CASE WHEN SUM(revenue) <> 0 THEN ROUND(CAST(SUM(revenue - cost) AS DOUBLE) / CAST(SUM(revenue) AS DOUBLE) * 100, 2) ELSE 0 END AS margin
FROM ledger_v
"""))
def health_totals(spark: SparkSession, d: str) -> DataFrame:
    return _double(h.totals(h.ledger(view(spark, d, "ledger_v"), ROLES, []), []))


_POINT_COLUMNS = """ SELECT k, CAST(back AS INTEGER) AS back, period, CAST(revenue AS DOUBLE) AS revenue, CAST(cost AS DOUBLE) AS cost,
  CAST(profit AS DOUBLE) AS profit FROM points"""


@query("health_history", oracle("ledger_v", body=_points_sql("k_small") + _POINT_COLUMNS))
def health_history(spark: SparkSession, d: str) -> DataFrame:
    return _double(h.history(_rows(spark, d, "k_small"), ["k_small"], ORDER).withColumnRenamed("k_small", "k"))


@query("health_trend", oracle("ledger_v", body=_points_sql("k_small") + _TRENDS + " SELECT * FROM trends"))
def health_trend(spark: SparkSession, d: str) -> DataFrame:
    return h.trends(_rows(spark, d, "k_small"), ["k_small"], ORDER).withColumnRenamed("k_small", "k")


@query("health_status", oracle("ledger_v", body=_points_sql("k") + _TRENDS + _STATUS + """
SELECT status, reason, COUNT(*) AS n FROM final GROUP BY 1, 2"""))
def health_status(spark: SparkSession, d: str) -> DataFrame:
    return _health(spark, d, "k").groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("health_long", oracle("ledger_v", body=_points_sql("k") + """
SELECT k, period, 'total_revenue' AS variable, CAST(revenue AS DOUBLE) AS value FROM points
UNION ALL SELECT k, period, 'total_cost', CAST(cost AS DOUBLE) FROM points
UNION ALL SELECT k, period, 'total_profit', CAST(profit AS DOUBLE) FROM points"""))
def health_long(spark: SparkSession, d: str) -> DataFrame:
    return h.long_form(_double(h.history(_rows(spark, d, "k"), ["k"], ORDER)), ["k"])


_WHOLE = _points_sql("0") + _TRENDS + _STATUS + " SELECT * EXCLUDE (k) FROM final"


@query("health_table", oracle("ledger_v", body=_WHOLE))
def health_table(spark: SparkSession, d: str) -> DataFrame:
    """The whole table as one business."""
    return _double(h.health(h.ledger(view(spark, d, "ledger_v"), ROLES, [], ORDER), [], ORDER))


@query("health_table_few", oracle("ledger_v", body=_WHOLE.replace("s.n_dated <= 10", "true").replace("s.n_dated > 10", "false")))
def health_table_few(spark: SparkSession, d: str) -> DataFrame:
    """The whole table judged by its last rows instead of its months."""
    rows = h.ledger(view(spark, d, "ledger_v"), ROLES, [], ORDER)
    return _double(h.health(rows, [], ORDER, dense_over=1 << 60))


@query("health_nan", oracle("ledger_v", body=_points_sql("k").replace(
    "FROM ledger_v", "FROM (SELECT * REPLACE (CASE WHEN seq % 7 = 0 THEN 0 ELSE floor(CAST(revenue AS DOUBLE)) END AS revenue,"
    " floor(CAST(cost AS DOUBLE)) AS cost) FROM ledger_v)") + _TRENDS + _STATUS + " SELECT * FROM final"))
def health_nan(spark: SparkSession, d: str) -> DataFrame:
    """Values that are no numbers count as 0."""
    whole = {c: F.floor(F.col(c).cast("double")).cast("double") for c in ("revenue", "cost")}
    rows = view(spark, d, "ledger_v").withColumns(whole)
    rows = rows.withColumn("revenue", F.when(F.col("seq") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("revenue")))
    return _double(h.health(h.ledger(rows, ROLES, ["k"], ORDER), ["k"], ORDER))


def _money_sql(c: str) -> str:
    return f"format('{{:,.2f}}', {c})"


_REPORT = f""" SELECT *, reason || ' Suggest further audit of financial statements.' AS summary,
  'Total Revenue: ' || {_money_sql("revenue")} || ' (Trend: ' || revenue_trend || '); Total Cost: ' || {_money_sql("cost")} || ' (Trend: '
  || cost_trend || '); Net Profit: ' || {_money_sql("profit")} || ' (Trend: ' || profit_trend || '); Profit Margin: '
  || {_money_sql("margin")} || '%' AS figures FROM final"""


@query("health_report", oracle("ledger_v", body=_points_sql("k") + _TRENDS + _STATUS + _REPORT))
def health_report(spark: SparkSession, d: str) -> DataFrame:
    return h.report(_health(spark, d, "k"))
