"""Business health of every entity of a ledger in one job.

Rows are reduced once to (entity, month) sums; totals, history and trends all
come from that small table. Only entities with few dated rows need single rows,
and of those at most ``periods`` per entity leave a task.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.clean import metric_value, time_value
from ..session import cut

METRICS = ("revenue", "cost", "profit")

# The reason texts of the four outcomes.
REASON_LOSS = "The business is currently operating at a net loss."
REASON_COST = "Expenses are rising faster than revenue, threatening future margins."
REASON_MARGIN = "Profit margins are low, indicating potential sensitivity to cost changes."
REASON_GOOD = "The business shows positive profit margins and stable or improving trends."
ADVICE = "Suggest further audit of financial statements."
NO_ROLES = "This sheet doesn't seem to contain recognizable financial metrics (Revenue/Cost/Profit)."


@dataclass(frozen=True)
class Roles:
    revenue: list[str] = field(default_factory=list)
    cost: list[str] = field(default_factory=list)
    profit: list[str] = field(default_factory=list)
    time: list[str] = field(default_factory=list)

    @property
    def sufficient(self) -> bool:
        return bool(self.revenue or self.cost or self.profit)


def roles_from_columns(columns: list[tuple[str, str]]) -> Roles:
    """Roles from (name, role) pairs as the column profile gives them."""
    pick = lambda *wanted: [n for n, r in columns if r in wanted]
    return Roles(revenue=pick("revenue"), cost=pick("expense"), time=pick("date"))


def ledger(df: DataFrame, roles: Roles, by: list[str], order: list[str] = ()) -> DataFrame:
    """``by, ts, revenue, cost, profit`` and the tie-break columns, one row per input row."""
    if not roles.sufficient:
        raise ValueError(NO_ROLES)

    def total(names: list[str]) -> Column:
        return reduce(lambda a, b: a + b, [metric_value(df, n) for n in names]) if names else F.lit(0)

    ts = time_value(df, roles.time[0]) if roles.time else F.lit(None).cast("timestamp_ntz")
    rows = df.select(
        *by, *[F.col(o) for o in order], ts.alias("ts"),
        total(roles.revenue).alias("revenue"), total(roles.cost).alias("cost"),
        *([total(roles.profit).alias("profit")] if roles.profit else []),
    )
    if not roles.profit:
        rows = rows.withColumn("profit", F.col("revenue") - F.col("cost"))
    return rows


def monthly(rows: DataFrame, by: list[str]) -> DataFrame:
    """Sums per entity and calendar month; undated rows form the null month."""
    return rows.groupBy(*by, F.trunc(F.to_date("ts"), "MM").alias("month")).agg(
        *[F.sum(m).alias(m) for m in METRICS], F.count(F.lit(1)).alias("n_rows")
    )


def margin(profit: Column, revenue: Column) -> Column:
    """Profit in percent of revenue with two decimals, 0 without revenue."""
    p, r = profit.cast("double"), revenue.cast("double")
    return F.when(r != 0, F.round(F.try_divide(p, r) * 100, 2)).otherwise(F.lit(0.0))


def totals(rows: DataFrame, by: list[str]) -> DataFrame:
    """Totals of all rows, dated or not."""
    sums = rows.groupBy(*by).agg(*[F.sum(m).alias(m) for m in METRICS])
    return sums.withColumn("margin", margin(F.col("profit"), F.col("revenue")))


def _months_back(i: Column | int) -> Column:
    return F.add_months(F.col("last_month"), -(F.lit(i) if isinstance(i, int) else i))


def _summary(rows: DataFrame, by: list[str], periods: int) -> DataFrame:
    """Per entity: totals, number of dated rows and the sums of its last months, gaps as 0."""
    m = monthly(rows, by)
    whole = Window.partitionBy(*by)
    m = m.withColumn("last_month", F.max("month").over(whole))
    slots = [
        F.coalesce(F.sum(F.when(F.col("month") == _months_back(i), F.col(x))), F.lit(0)).alias(f"_{x}_{i}")
        for i in range(periods) for x in METRICS
    ]
    return m.groupBy(*by).agg(
        *[F.sum(x).alias(x) for x in METRICS],
        F.coalesce(F.sum(F.when(F.col("month").isNotNull(), F.col("n_rows"))), F.lit(0)).alias("n_dated"),
        F.min("month").alias("first_month"), F.max("last_month").alias("last_month"), *slots,
    )


def _keyed(rows: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    """Without a key the whole table is one entity; its rows get a constant key."""
    return (rows, by) if by else (rows.withColumn("_all", F.lit(0)), ["_all"])


def _last_rows(rows: DataFrame, by: list[str], order: list[str], periods: int) -> DataFrame:
    """The last ``periods`` dated rows per entity; the rank filter prunes inside each task."""
    w = Window.partitionBy(*by).orderBy(F.col("ts").desc(), *[F.col(o).desc() for o in order])
    return rows.where(F.col("ts").isNotNull()).withColumn("_back", F.row_number().over(w)).where(
        F.col("_back") <= periods
    )


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)])


def _few(rows: DataFrame, summary: DataFrame, by: list[str], order: list[str], periods: int, dense_over: int):
    """Last rows of the entities with few dated rows, or None when there is no such entity."""
    few = summary.where(F.col("n_dated").between(1, dense_over)).select(*[F.col(k).alias(f"_f_{k}") for k in by])
    if few.isEmpty():
        return None
    # The rows of large entities go out first. The size of the written table tells the optimiser how to join.
    rows = rows.join(cut(few), _same(by, [f"_f_{k}" for k in by]), "left_semi")
    return _last_rows(rows, by, order, periods)


def _span(periods: int) -> Column:
    """Index of the oldest month of the history, 0 being the newest."""
    return F.least(F.lit(periods - 1), F.months_between("last_month", "first_month").cast("int"))


def _slot(metric: str, i: Column, periods: int) -> Column:
    return F.element_at(F.array(*[F.col(f"_{metric}_{k}") for k in range(periods)]), i + 1)


def history(
    rows: DataFrame, by: list[str], order: list[str] = (), periods: int = 3, dense_over: int = 10
) -> DataFrame:
    """The last points of every entity: ``by, back`` (0 = newest), ``period`` and the metrics.

    More than ``dense_over`` dated rows: month sums labelled by month end, absent
    months 0. Otherwise the last rows as they are.
    """
    rows, keys = _keyed(rows, by)
    summary = cut(_summary(rows, keys, periods))
    points = F.transform(F.sequence(F.lit(0), _span(periods)), lambda i: F.struct(
        i.alias("back"),
        F.last_day(F.add_months(F.col("last_month"), -i)).cast("string").alias("period"),
        *[_slot(m, i, periods).alias(m) for m in METRICS],
    ))
    dense = summary.where(F.col("n_dated") > dense_over).select(*by, F.explode(points).alias("p")).select(*by, "p.*")
    few = _few(rows, summary, keys, list(order), periods, dense_over)
    if few is None:
        return dense
    return dense.unionByName(few.select(
        *by, (F.col("_back") - 1).alias("back"), F.col("ts").cast("string").alias("period"), *METRICS
    ))


def _with_ends(
    rows: DataFrame, by: list[str], order: list[str], periods: int, dense_over: int
) -> DataFrame:
    """Per entity: totals, number of history points, and each metric at the first and last point.

    The per-entity summary is materialised: it is small, and whether the ledger must
    be read a second time, for entities with few dated rows, is decided on it.
    """
    summary = cut(_summary(rows, by, periods))
    dense = F.col("n_dated") > dense_over
    ends = summary.select(
        *by, *METRICS, F.when(dense, _span(periods) + 1).alias("_dn"),
        *[F.when(dense, _slot(m, _span(periods), periods)).alias(f"_df_{m}") for m in METRICS],
        *[F.when(dense, F.col(f"_{m}_0")).alias(f"_dl_{m}") for m in METRICS],
    )
    few = _few(rows, summary, by, order, periods, dense_over)
    if few is None:
        return ends.select(
            *by, *METRICS, F.coalesce("_dn", F.lit(0)).alias("n_points"),
            *[F.col(f"_d{e}_{m}").alias(f"_{e}_{m}") for e in "fl" for m in METRICS],
        )
    single = few.groupBy(*[F.col(k).alias(f"_s_{k}") for k in by]).agg(
        F.count(F.lit(1)).cast("int").alias("_sn"),
        *[F.max_by(m, "_back").alias(f"_sf_{m}") for m in METRICS],
        *[F.min_by(m, "_back").alias(f"_sl_{m}") for m in METRICS],
    )
    return ends.join(single, _same(by, [f"_s_{k}" for k in by]), "left").select(
        *by, *METRICS, F.coalesce("_dn", "_sn", F.lit(0)).alias("n_points"),
        *[F.coalesce(f"_d{e}_{m}", f"_s{e}_{m}").alias(f"_{e}_{m}") for e in "fl" for m in METRICS],
    )


def _trend(metric: str) -> Column:
    """First against last point of the history; fewer than two points are stable."""
    first, last = F.col(f"_f_{metric}").cast("double"), F.col(f"_l_{metric}").cast("double")
    change = (last - first) / (F.abs(first) + F.lit(1e-9))
    return (
        F.when(F.col("n_points") < 2, "stable")
        .when(change > 0.05, "up").when(change < -0.05, "down").otherwise("stable")
    )


def trends(
    rows: DataFrame, by: list[str], order: list[str] = (), periods: int = 3, dense_over: int = 10
) -> DataFrame:
    """Trend of each metric for every entity with a history."""
    rows, keys = _keyed(rows, by)
    ends = _with_ends(rows, keys, list(order), periods, dense_over)
    return ends.where("n_points > 0").select(
        *by, F.col("n_points").cast("bigint").alias("n_points"), *[_trend(m).alias(f"{m}_trend") for m in METRICS]
    )


def status(profit: Column, margin_pct: Column, cost_trend: Column, revenue_trend: Column) -> tuple[Column, Column]:
    """(status, reason); the first rule that holds decides."""
    loss = profit < 0
    costly = (cost_trend == "up") & (revenue_trend != "up")
    thin = margin_pct < 10
    word = F.when(loss, "Risk").when(costly | thin, "Warning").otherwise("Healthy")
    why = (
        F.when(loss, REASON_LOSS).when(costly, REASON_COST).when(thin, REASON_MARGIN).otherwise(REASON_GOOD)
    )
    return word, why


def health(
    rows: DataFrame, by: list[str], order: list[str] = (), periods: int = 3, dense_over: int = 10
) -> DataFrame:
    """Totals, margin, trends, status and reason of every entity."""
    rows, keys = _keyed(rows, by)
    ends = _with_ends(rows, keys, list(order), periods, dense_over)
    judged = ends.select(
        *by, *METRICS, margin(F.col("profit"), F.col("revenue")).alias("margin"),
        *[_trend(m).alias(f"{m}_trend") for m in METRICS],
    )
    word, why = status(F.col("profit"), F.col("margin"), F.col("cost_trend"), F.col("revenue_trend"))
    return judged.withColumn("status", word).withColumn("reason", why)


def report(health_rows: DataFrame) -> DataFrame:
    """Health rows with the readable summary sentence."""
    def money(c: str) -> Column:
        return F.format_number(F.col(c).cast("double"), 2)

    return health_rows.withColumn("summary", F.concat_ws(" ", "reason", F.lit(ADVICE))).withColumn(
        "figures",
        F.concat(
            F.lit("Total Revenue: "), money("revenue"), F.lit(" (Trend: "), F.col("revenue_trend"),
            F.lit("); Total Cost: "), money("cost"), F.lit(" (Trend: "), F.col("cost_trend"),
            F.lit("); Net Profit: "), money("profit"), F.lit(" (Trend: "), F.col("profit_trend"),
            F.lit("); Profit Margin: "), F.format_number("margin", 2), F.lit("%"),
        ),
    )


def long_form(points: DataFrame, by: list[str]) -> DataFrame:
    """History points in long form for plotting: one row per metric."""
    renamed = points.withColumnsRenamed({m: f"total_{m}" for m in METRICS})
    return renamed.unpivot([*by, "period"], [f"total_{m}" for m in METRICS], "variable", "value")
