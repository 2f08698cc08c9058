"""Named metrics: what a question over a table compiles to.

Every builder takes a DataFrame and plain columns and returns a grouped DataFrame.
Division is null on a zero divisor; ratios are rounded half up.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .ordered import Ordered


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _over(a: Column, b: Column, digits: int, scale: float = 1.0) -> Column:
    a, b = a.cast("double"), b.cast("double")
    return F.round(a * F.lit(scale) / F.nullif(b, F.lit(0.0)), digits)


def total(df: DataFrame, value, by=(), name: str = "total") -> DataFrame:
    return df.groupBy(*by).agg(F.sum(_col(value)).alias(name))


def average(df: DataFrame, value, by=(), name: str = "average") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(_col(value)).alias(name))


def net(df: DataFrame, plus, minus, by=(), name: str = "net") -> DataFrame:
    return df.groupBy(*by).agg((F.sum(_col(plus)) - F.sum(_col(minus))).alias(name))


def margin(df: DataFrame, revenue, cost, by=()) -> DataFrame:
    """Revenue, cost, profit and margin in percent with two decimals."""
    sums = df.groupBy(*by).agg(F.sum(_col(revenue)).alias("total_revenue"), F.sum(_col(cost)).alias("total_cost"))
    profit = F.col("total_revenue") - F.col("total_cost")
    return sums.select(
        *by, "total_revenue", "total_cost", profit.alias("profit"),
        _over(profit, F.col("total_revenue"), 2, 100.0).alias("margin_pct"),
    )


def ratio(df: DataFrame, a, b, by=(), digits: int = 4, name: str = "ratio") -> DataFrame:
    return df.groupBy(*by).agg(_over(F.sum(_col(a)), F.sum(_col(b)), digits).alias(name))


def per_unit(df: DataFrame, amount, units, by=(), name: str = "per_unit") -> DataFrame:
    return ratio(df, amount, units, by, 2, name)


def sum_product(df: DataFrame, a, b, by=(), name: str = "total_value") -> DataFrame:
    return df.groupBy(*by).agg(F.sum(_col(a) * _col(b)).alias(name))


def spread(df: DataFrame, value, by=()) -> DataFrame:
    v = _col(value)
    return df.groupBy(*by).agg(F.stddev_samp(v).alias("stddev"), F.var_samp(v).alias("variance"))


def value_range(df: DataFrame, value, by=()) -> DataFrame:
    v = _col(value)
    return df.groupBy(*by).agg(
        F.min(v).alias("min_value"), F.max(v).alias("max_value"), (F.max(v) - F.min(v)).alias("range")
    )


def growth(df: DataFrame, value, period: str, by=()) -> DataFrame:
    """Change of the period total against the period before, one row per period."""
    sums = df.groupBy(*by, period).agg(F.sum(_col(value)).alias("total"))
    steps = Ordered(sums, list(by), [F.col(period)]).lag("total", "previous").done()
    return steps.withColumn("change", F.col("total") - F.col("previous"))


def growth_rate(df: DataFrame, value, period: str, by=()) -> DataFrame:
    """Multi-step form: period totals, change, then change in percent of the period before."""
    return growth(df, value, period, by).withColumn("change_pct", _over(F.col("change"), F.col("previous"), 2, 100.0))


def running_total(df: DataFrame, value, date: str, by=(), name: str = "running_total") -> DataFrame:
    """Running total by date, one row per date and key: rows of a date share the value.

    Dates are summed first, so the ordered pass runs over dates and not over rows.
    """
    sums = df.groupBy(*by, date).agg(F.sum(_col(value)).alias("_day"))
    return Ordered(sums, list(by), [F.col(date)]).running_sum(F.col("_day"), name).done().drop("_day")


def with_running_total(df: DataFrame, value, date: str, by=(), name: str = "running_total") -> DataFrame:
    """Running total attached to every row, equal for rows of one date."""
    return df.join(running_total(df, value, date, by, name), [*by, date])


def top_n(df: DataFrame, metric: str, n: int, tie: list[str]) -> DataFrame:
    return df.orderBy(F.col(metric).desc_nulls_last(), *tie).limit(n)


def share_of_total(df: DataFrame, category: str, value, pie_categories: int = 6) -> DataFrame:
    """Share of every category in percent; ``pie_fits`` tells whether they are few enough for a pie chart."""
    sums = cut(df.groupBy(category).agg(F.sum(_col(value)).alias("total")))
    # Two numbers come back to the driver.
    whole, categories = sums.agg(F.sum("total").cast("double"), F.count(F.lit(1))).first()
    share = _over(F.col("total"), F.lit(whole).cast("double"), 2, 100.0)
    return sums.withColumns({"share_pct": share, "pie_fits": F.lit(categories <= pie_categories)})


TIME_WORDS = ("date", "time", "year", "month", "day")


@dataclass(frozen=True)
class ChartSpec:
    x_axis: str
    y_axis: str
    chart_type: str


def column_class(field: T.StructField) -> str:
    if any(w in field.name.lower() for w in TIME_WORDS) or isinstance(
        field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)
    ):
        return "time"
    return "numeric" if isinstance(field.dataType, T.NumericType) else "category"


def chart_spec(df: DataFrame) -> ChartSpec | None:
    """Time with a number is a line, category with a number a bar; else no chart."""
    kinds: dict[str, list[str]] = {"time": [], "category": [], "numeric": []}
    for f in df.schema:
        kinds[column_class(f)].append(f.name)
    if not kinds["numeric"]:
        return None
    if kinds["time"]:
        return ChartSpec(kinds["time"][0], kinds["numeric"][0], "line")
    if kinds["category"]:
        return ChartSpec(kinds["category"][0], kinds["numeric"][0], "bar")
    return None


def valid_spec(df: DataFrame, spec: ChartSpec) -> bool:
    return all(not c or c in df.columns for c in (spec.x_axis, spec.y_axis))


def chart_data(df: DataFrame, spec: ChartSpec | None = None) -> DataFrame | None:
    """One x, one y, summed; ordered by x when x is a time."""
    spec = spec or chart_spec(df)
    if spec is None or not valid_spec(df, spec):
        return None
    out = df.groupBy(F.col(spec.x_axis).alias("x")).agg(F.sum(spec.y_axis).alias("y"))
    return out.orderBy("x") if spec.chart_type == "line" else out
