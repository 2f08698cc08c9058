"""Role policies over sheets, and auditing of query text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import POLICIES, POLICY_SEED

# Patterns that mark row-level access, and those that mark aggregation.
ROW_LEVEL_PATTERNS = (r"select\s+\*", r"limit", r"offset")
AGGREGATE_PATTERNS = (r"sum\(", r"avg\(", r"count\(", r"max\(", r"min\(", r"group\s+by")
STRICT_ROW_LEVEL = (r"\bselect\s+\*", r"\blimit\b", r"\boffset\b")
STRICT_AGGREGATE = (
    r"\bsum\s*\(", r"\bavg\s*\(", r"\bcount\s*\(", r"\bmax\s*\(", r"\bmin\s*\(", r"\bgroup\s+by\b",
)

FLAGS = ("allowed", "allow_aggregation", "allow_raw_rows")
KEY = ("data_domain", "sensitivity_level")


def seed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLICY_SEED, POLICIES)


def seed_if_empty(existing: DataFrame) -> DataFrame:
    """Existing policies, or the seed when there are none."""
    return seed(existing.sparkSession) if existing.isEmpty() else existing.select(*POLICIES.fieldNames())


def duplicate_policies(policies: DataFrame) -> DataFrame:
    return policies.groupBy("role", *KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(policies: DataFrame) -> DataFrame:
    """The policies themselves; an error if a (role, domain, level) occurs twice."""
    twice = duplicate_policies(policies).first()
    if twice is not None:
        raise ValueError(f"more than one policy for {twice['role']} on {twice['data_domain']}/{twice['sensitivity_level']}")
    return policies


def visible_sheets(sheets: DataFrame, policies: DataFrame, role: str) -> DataFrame:
    """Sheets the role may see, with its rights.

    A sheet without domain or level is visible with aggregate rights; any other
    needs an allowing policy. The role filter is applied to the policies before
    the join, which leaves one row per (domain, level).
    """
    mine = policies.where((F.col("role") == role) & F.col("allowed")).groupBy(*KEY).agg(
        # Of doubled policies the narrower rights hold.
        F.bool_and("allow_aggregation").alias("_agg"), F.bool_and("allow_raw_rows").alias("_raw"),
        F.lit(True).alias("_hit"),
    )
    return (
        sheets.join(mine, list(KEY), "left")
        .where(F.col("_hit") | F.col("data_domain").isNull() | F.col("sensitivity_level").isNull())
        .withColumn("allow_aggregation", F.coalesce("_agg", F.lit(True)))
        .withColumn("allow_raw_rows", F.coalesce("_raw", F.lit(False)))
        .drop("_hit", "_agg", "_raw")
    )


def check_permission(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """Rights of each request (role, data_domain, sensitivity_level); without a policy all are denied."""
    on = ["role", *KEY]
    known = policies.select(*on, *FLAGS, F.lit(True).alias("_hit"))
    missing = F.concat(
        F.lit("No policy found for "), F.col("role"), F.lit(" accessing "),
        F.col("data_domain"), F.lit("/"), F.col("sensitivity_level"),
    )
    return (
        requests.join(known, on, "left")
        .withColumn("message", F.when(F.col("_hit").isNull(), missing)
                    .when(F.col("allowed"), "Access allowed").otherwise("Access denied"))
        .withColumns({f: F.coalesce(f, F.lit(False)) for f in FLAGS})
        .drop("_hit")
    )


def role_policies(policies: DataFrame, role: str) -> DataFrame:
    """All policies of a role in order, each with the total count."""
    mine = policies.where(F.col("role") == role)
    n = mine.count()
    return mine.select(*KEY, *FLAGS, F.lit(n).cast("bigint").alias("total_policies")).orderBy(*KEY)


def _any(text: Column, patterns) -> Column:
    hit = text.rlike(patterns[0])
    for p in patterns[1:]:
        hit = hit | text.rlike(p)
    return hit


def audit(sql: Column, allow_raw: Column, strict: bool = False) -> dict[str, Column]:
    """``valid``, ``access_level`` and ``reason`` of a statement's text."""
    text = F.lower(sql)
    raw = F.coalesce(allow_raw, F.lit(False))
    row_level = _any(text, STRICT_ROW_LEVEL if strict else ROW_LEVEL_PATTERNS)
    aggregated = _any(text, STRICT_AGGREGATE if strict else AGGREGATE_PATTERNS)
    return {
        "valid": raw | (~row_level & aggregated),
        "access_level": F.when(raw, "raw").when(~row_level & aggregated, "aggregated"),
        "reason": F.when(raw, "ok").when(row_level, "raw rows not allowed")
        .when(~aggregated, "aggregation required").otherwise("ok"),
    }


def audit_sql(log: DataFrame, sql: str = "sql_query", allow_raw: str = "allow_raw", strict: bool = False) -> DataFrame:
    return log.withColumns(audit(F.col(sql), F.col(allow_raw), strict))


# Functions that reduce many rows to one number or value.
GUARDED = ("sum", "avg", "count", "min", "max", "stddev", "variance")


def guarded_agg(
    df: DataFrame, by: list[str], aggs: dict[str, tuple[str, str]], allow_aggregation: bool, allow_raw_rows: bool
) -> DataFrame:
    """Aggregates, as name -> (function, column), for a role that may not see rows; without any right an error.

    Functions come from a closed list, as an expression could gather whole rows.
    """
    if not (allow_aggregation or allow_raw_rows):
        raise PermissionError("no access to this data domain")
    unknown = [f for f, _ in aggs.values() if f not in GUARDED]
    if not aggs or unknown:
        raise PermissionError("only aggregated output is permitted")
    return df.groupBy(*by).agg(*[getattr(F, f)(F.col(c)).alias(name) for name, (f, c) in aggs.items()])
