"""Metric queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as m
from ..operators.catalog import preview, union_tables
from ..operators.policy import guarded_agg
from .registry import query
from .views import oracle, table, view


def _money(name: str, scale: int = 2):
    return F.col(name).cast(f"decimal(18,{scale})")


def _double(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


@query("m_sum", """
SELECT l_returnflag, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem GROUP BY 1
""")
def m_sum(spark: SparkSession, d: str) -> DataFrame:
    return _double(m.total(table(spark, d, "lineitem"), _money("l_extendedprice"), ["l_returnflag"]), "total")


@query("m_avg", """
SELECT l_returnflag, l_linestatus,
  ROUND(CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / COUNT(l_quantity), 4) AS average
FROM lineitem GROUP BY 1, 2
""")
def m_avg(spark: SparkSession, d: str) -> DataFrame:
    out = m.average(table(spark, d, "lineitem"), _money("l_quantity"), ["l_returnflag", "l_linestatus"])
    return out.withColumn("average", F.round(F.col("average").cast("double"), 4))


@query("m_net", oracle("ledger_v", body="""
SELECT k, CAST(SUM(revenue) - SUM(cost) AS DOUBLE) AS net FROM ledger_v GROUP BY 1
"""))
def m_net(spark: SparkSession, d: str) -> DataFrame:
    return _double(m.net(view(spark, d, "ledger_v"), "revenue", "cost", ["k"]), "net")


@query("m_margin", oracle("ledger_v", body="""
SELECT k, CAST(SUM(revenue) AS DOUBLE) AS total_revenue, CAST(SUM(cost) AS DOUBLE) AS total_cost,
  CAST(SUM(revenue) - SUM(cost) AS DOUBLE) AS profit,
  ROUND(CAST(SUM(revenue) - SUM(cost) AS DOUBLE) * 100.0::DOUBLE / NULLIF(CAST(SUM(revenue) AS DOUBLE), 0), 2) AS margin_pct
FROM ledger_v GROUP BY k
"""))
def m_margin(spark: SparkSession, d: str) -> DataFrame:
    out = m.margin(view(spark, d, "ledger_v"), "revenue", "cost", ["k"])
    return _double(out, "total_revenue", "total_cost", "profit")


@query("m_ratio", """
SELECT l_partkey, ROUND(CAST(SUM(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE)
  / NULLIF(CAST(SUM(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE), 0), 4) AS ratio
FROM lineitem GROUP BY 1
""")
def m_ratio(spark: SparkSession, d: str) -> DataFrame:
    return m.ratio(table(spark, d, "lineitem"), _money("l_discount"), _money("l_tax"), ["l_partkey"])


@query("m_sum_product", """
SELECT l_suppkey, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2)) * CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_value
FROM lineitem GROUP BY 1
""")
def m_sum_product(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem")
    return _double(m.sum_product(df, _money("l_quantity"), _money("l_extendedprice"), ["l_suppkey"]), "total_value")


@query("m_per_unit", """
SELECT l_partkey, ROUND(CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)
  / NULLIF(CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE), 0), 2) AS per_unit
FROM lineitem GROUP BY 1
""")
def m_per_unit(spark: SparkSession, d: str) -> DataFrame:
    return m.per_unit(table(spark, d, "lineitem"), _money("l_extendedprice"), _money("l_quantity"), ["l_partkey"])


@query("m_spread", """
SELECT o_custkey, ROUND(STDDEV_SAMP(o_totalprice), 2) AS stddev, ROUND(VAR_SAMP(o_totalprice), 0) AS variance
FROM orders GROUP BY 1
""")
def m_spread(spark: SparkSession, d: str) -> DataFrame:
    out = m.spread(table(spark, d, "orders"), "o_totalprice", ["o_custkey"])
    return out.select("o_custkey", F.round("stddev", 2).alias("stddev"), F.round("variance", 0).alias("variance"))


@query("m_range", """
SELECT l_suppkey, CAST(MIN(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS min_value,
  CAST(MAX(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS max_value,
  CAST(MAX(CAST(l_extendedprice AS DECIMAL(18,2))) - MIN(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS range
FROM lineitem GROUP BY 1
""")
def m_range(spark: SparkSession, d: str) -> DataFrame:
    out = m.value_range(table(spark, d, "lineitem"), _money("l_extendedprice"), ["l_suppkey"])
    return _double(out, "min_value", "max_value", "range")


def _by_month(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "ledger_v").withColumn("period", F.date_format("ts", "yyyy-MM"))


@query("m_growth", oracle("ledger_v", body="""
SELECT k, period, CAST(total AS DOUBLE) AS total, CAST(LAG(total) OVER w AS DOUBLE) AS previous,
  CAST(total - LAG(total) OVER w AS DOUBLE) AS change
FROM (SELECT k, strftime(ts, '%Y-%m') AS period, SUM(revenue) AS total FROM ledger_v GROUP BY 1, 2)
WINDOW w AS (PARTITION BY k ORDER BY period)
"""))
def m_growth(spark: SparkSession, d: str) -> DataFrame:
    return _double(m.growth(_by_month(spark, d), "revenue", "period", ["k"]), "total", "previous", "change")


@query("m_cte_growth", oracle("ledger_v", body="""
WITH sums AS (SELECT strftime(ts, '%Y') AS period, SUM(revenue) AS total FROM ledger_v GROUP BY 1),
steps AS (SELECT period, total, LAG(total) OVER (ORDER BY period) AS previous FROM sums)
SELECT period, CAST(total AS DOUBLE) AS total, CAST(previous AS DOUBLE) AS previous,
  CAST(total - previous AS DOUBLE) AS change,
  ROUND(CAST(total - previous AS DOUBLE) * 100.0::DOUBLE / NULLIF(CAST(previous AS DOUBLE), 0), 2) AS change_pct FROM steps
"""))
def m_cte_growth(spark: SparkSession, d: str) -> DataFrame:
    df = view(spark, d, "ledger_v").withColumn("period", F.date_format("ts", "yyyy"))
    return _double(m.growth_rate(df, "revenue", "period"), "total", "previous", "change")


@query("m_running", oracle("ledger_v", body="""
SELECT k, ts_day, CAST(running_total AS DOUBLE) AS running_total FROM (
  SELECT DISTINCT k, CAST(ts AS DATE)::VARCHAR AS ts_day,
    SUM(revenue) OVER (PARTITION BY k ORDER BY CAST(ts AS DATE)) AS running_total FROM ledger_v)
"""))
def m_running(spark: SparkSession, d: str) -> DataFrame:
    df = view(spark, d, "ledger_v").withColumn("ts_day", F.to_date("ts"))
    out = m.running_total(df, "revenue", "ts_day", ["k"])
    return _double(out.withColumn("ts_day", F.col("ts_day").cast("string")), "running_total")


@query("m_running_rows", """
SELECT o_orderkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate) AS DOUBLE) AS running_total
FROM orders
""")
def m_running_rows(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders")
    out = m.with_running_total(df, _money("o_totalprice"), "o_orderdate", ["o_orderstatus"])
    return _double(out.select("o_orderkey", "running_total"), "running_total")


@query("m_topn", """
SELECT l_suppkey, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem GROUP BY 1
ORDER BY total DESC, l_suppkey LIMIT 10
""")
def m_topn(spark: SparkSession, d: str) -> DataFrame:
    sums = m.total(table(spark, d, "lineitem"), _money("l_extendedprice"), ["l_suppkey"])
    return m.top_n(_double(sums, "total"), "total", 10, ["l_suppkey"])


@query("share_of_total", """
WITH s AS (SELECT c_mktsegment, SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS total FROM customer GROUP BY 1)
SELECT c_mktsegment, CAST(total AS DOUBLE) AS total,
  ROUND(CAST(total AS DOUBLE) * 100.0::DOUBLE / NULLIF(CAST((SELECT SUM(total) FROM s) AS DOUBLE), 0), 2) AS share_pct,
  (SELECT COUNT(*) FROM s) <= 6 AS pie_fits
FROM s
""")
def share_of_total(spark: SparkSession, d: str) -> DataFrame:
    return _double(m.share_of_total(table(spark, d, "customer"), "c_mktsegment", _money("c_acctbal")), "total")


@query("share_many", """
WITH s AS (SELECT p_brand, SUM(p_size) AS total FROM part GROUP BY 1)
SELECT p_brand, CAST(total AS BIGINT) AS total,
  ROUND(CAST(total AS DOUBLE) * 100.0::DOUBLE / CAST((SELECT SUM(total) FROM s) AS DOUBLE), 2) AS share_pct,
  (SELECT COUNT(*) FROM s) <= 6 AS pie_fits
FROM s
""")
def share_many(spark: SparkSession, d: str) -> DataFrame:
    return m.share_of_total(table(spark, d, "part"), "p_brand", "p_size")


@query("chart_data", """
SELECT strftime(o_orderdate, '%Y-%m') AS x, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS y
FROM orders GROUP BY 1
""")
def chart_data(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").select(
        "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM").alias("order_month"),
        _money("o_totalprice").alias("amount"),
    )
    return _double(m.chart_data(df), "y")


@query("chart_bars", """
SELECT p_brand AS x, CAST(SUM(p_size) AS BIGINT) AS y FROM part GROUP BY 1
""")
def chart_bars(spark: SparkSession, d: str) -> DataFrame:
    return m.chart_data(table(spark, d, "part").select("p_brand", "p_size"))


@query("guarded_agg", """
SELECT o_orderpriority, COUNT(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders GROUP BY 1
""")
def guarded(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumn("price", _money("o_totalprice"))
    aggs = {"n": ("count", "o_orderkey"), "total": ("sum", "price")}
    return _double(guarded_agg(orders, ["o_orderpriority"], aggs, True, False), "total")


@query("preview", """
SELECT o_orderkey, o_custkey, o_orderstatus, (SELECT COUNT(*) FROM orders) - 10 AS more_rows
FROM orders ORDER BY o_orderkey LIMIT 10
""")
def preview_rows(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return preview(df, ["o_orderkey"], 10)


@query("union_tables", """
SELECT 'customer' AS kind, c_custkey AS key, c_name AS name, c_acctbal AS balance, NULL::INTEGER AS size FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal, NULL FROM supplier
UNION ALL SELECT 'part', p_partkey, p_name, NULL, p_size FROM part
""")
def unions(spark: SparkSession, d: str) -> DataFrame:
    def pick(source: str, **cols: str) -> DataFrame:
        return table(spark, d, source).select(F.lit(source).alias("kind"), *[F.col(c).alias(a) for a, c in cols.items()])

    return union_tables([
        pick("customer", key="c_custkey", name="c_name", balance="c_acctbal"),
        pick("supplier", key="s_suppkey", name="s_name", balance="s_acctbal"),
        pick("part", key="p_partkey", name="p_name", size="p_size"),
    ])


@query("filter_ilike", """
SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment ILIKE '%chin%'
""")
def filter_ilike(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where(F.col("c_mktsegment").ilike("%chin%")).select(
        "c_custkey", "c_name", "c_mktsegment"
    )
