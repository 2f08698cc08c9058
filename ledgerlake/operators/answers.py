"""Answering a question: an audited statement over each ranked candidate, the first meaningful result wins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from . import metrics
from .policy import audit


@dataclass(frozen=True)
class MetricSpec:
    """A named metric instead of a statement: a builder of ``metrics`` with its arguments."""

    metric: str
    arguments: dict = field(default_factory=dict)

    def run(self, df: DataFrame) -> DataFrame:
        if self.metric not in METRICS:
            raise ValueError(f"no metric {self.metric}")
        return getattr(metrics, self.metric)(df, **self.arguments)


# The builders a question may name; each returns aggregates only.
METRICS = (
    "total", "average", "net", "margin", "ratio", "per_unit", "sum_product", "spread", "value_range", "growth", "growth_rate",
    "running_total", "share_of_total",
)


@dataclass(frozen=True)
class Answer:
    """What came of one candidate. ``result`` is None when its policy refused the statement."""

    candidate: Row
    result: DataFrame | None
    reason: str
    meaningful: bool


def is_meaningful(result: DataFrame) -> bool:
    """More than one cell, or one that is neither null, NaN nor 0. At most two rows are read."""
    rows = result.limit(2).collect()
    cells = [v for r in rows for v in r]
    if len(cells) != 1:
        return bool(cells)
    value = cells[0]
    return value is not None and value == value and value not in (0, "0")


def audited(spark: SparkSession, statement: str, allow_raw: bool) -> tuple[bool, str]:
    """Whether a statement may run for these rights, and why not."""
    marks = audit(F.lit(statement), F.lit(allow_raw))
    row = spark.range(1).select(marks["valid"].alias("valid"), marks["reason"].alias("reason")).first()
    return row.valid, row.reason


def answer(
    spark: SparkSession, candidates: DataFrame, question: str | MetricSpec, load: Callable[[Row], DataFrame],
    allow_raw: str = "allow_raw_rows",
) -> list[Answer]:
    """One ``Answer`` per candidate up to the first meaningful one.

    ``candidates`` are the few ranked rows of a search, with the rights of the request; ``load`` gives the data table of one. A statement
    names that table as ``{table}``. It is audited for each candidate, as rights differ.
    """
    out = []
    for candidate in candidates.collect():
        if isinstance(question, MetricSpec):
            result, reason = question.run(load(candidate)), "ok"
        else:
            allowed, reason = audited(spark, question, bool(candidate[allow_raw]))
            result = spark.sql(question, table=load(candidate)) if allowed else None
        good = result is not None and is_meaningful(result)
        out.append(Answer(candidate, result, reason, good))
        if good:
            break
    return out


def best(answers: list[Answer]) -> Answer | None:
    """The first meaningful answer, else the first that ran, else None."""
    ran = [a for a in answers if a.result is not None]
    return next((a for a in ran if a.meaningful), ran[0] if ran else None)
