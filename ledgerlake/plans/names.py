"""Queries over names, cleaning and column profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean, names
from ..operators import profile
from ..operators.catalog import parse_columns_metadata
from ..schemas import COLUMN_META
from .registry import query
from .views import oracle, table, view

_WORDS = ", ".join(f"'{w}'" for w in names.RESERVED)
SNAKE_SQL = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '_')"


def name_sql(x: str) -> str:
    s = SNAKE_SQL.format(x=f"COALESCE({x}, '')")
    return (f"CASE WHEN {s} = '' THEN 'unnamed' WHEN regexp_matches({s}, '^[0-9]') OR {s} IN ({_WORDS}) "
            f"THEN '_' || {s} ELSE {s} END")


def csv_name_sql(x: str) -> str:
    return f"trim(lower(regexp_replace(COALESCE({x}, 'None'), '[^\\p{{L}}\\p{{N}}]', '_', 'g')), '_')"


def word_name_sql(x: str) -> str:
    s = SNAKE_SQL.format(x=f"COALESCE({x}, 'None')")
    return f"CASE WHEN {s} = '' OR regexp_matches({s}, '^[0-9]') THEN 'col_' || {s} ELSE {s} END"


@query("norm_name", oracle("headers_v", body=f"SELECT id, {name_sql('name')} AS norm FROM headers_v"))
def norm_name(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "headers_v").select("id", names.normalize_name(F.col("name")).alias("norm"))


@query("norm_name_csv", oracle("headers_v", body=f"SELECT id, {csv_name_sql('name')} AS norm FROM headers_v"))
def norm_name_csv(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "headers_v").select("id", names.normalize_name_csv(F.col("name")).alias("norm"))


@query("norm_name_word", oracle("headers_v", body=f"SELECT id, {word_name_sql('name')} AS norm FROM headers_v"))
def norm_name_word(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "headers_v").select("id", names.normalize_name_word(F.col("name")).alias("norm"))


@query("dedup_names", oracle("headers_v", body=rf"""
WITH normed AS (SELECT table_id, id, norm, ROW_NUMBER() OVER (PARTITION BY table_id, norm ORDER BY id) - 1 AS nth
  FROM (SELECT table_id, id, {name_sql('name')} AS norm FROM headers_v)),
used AS (SELECT DISTINCT table_id, norm FROM normed),
numbers AS (SELECT table_id, norm, unnest(range(1, 100)) AS k FROM used),
free AS (SELECT table_id, norm, k, ROW_NUMBER() OVER (PARTITION BY table_id, norm ORDER BY k) AS nth
  FROM numbers n WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.table_id = n.table_id AND u.norm = n.norm || '_' || CAST(n.k AS VARCHAR)))
SELECT n.table_id, n.id, n.norm, CASE WHEN n.nth = 0 THEN n.norm ELSE n.norm || '_' || CAST(f.k AS VARCHAR) END AS final_name
FROM normed n LEFT JOIN free f ON f.table_id = n.table_id AND f.norm = n.norm AND f.nth = n.nth
"""))
def dedup_names(spark: SparkSession, d: str) -> DataFrame:
    named = view(spark, d, "headers_v").select("table_id", "id", names.normalize_name(F.col("name")).alias("norm"))
    return names.dedup_names(named, ["table_id"], "id", "norm")


@query("clean_number", oracle("money_text_v", body=r"""
SELECT id, COALESCE(TRY_CAST(regexp_replace(raw, '[^\d.-]', '', 'g') AS DOUBLE), 0) AS number FROM money_text_v
"""))
def clean_number(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "money_text_v").select("id", clean.clean_number(F.col("raw")).alias("number"))


@query("clean_date", oracle("date_text_v", body="""
SELECT id, CASE id % 6 WHEN 0 THEN iso WHEN 1 THEN iso WHEN 2 THEN substr(iso, 1, 4) || '-03-' || substr(iso, 9, 2)
  WHEN 3 THEN substr(iso, 1, 4) || '-01-01' END AS day FROM date_text_v
"""))
def clean_date(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "date_text_v").select(
        "id", F.date_format(clean.clean_date(F.col("raw")), "yyyy-MM-dd").alias("day")
    )


def _with_holes(spark: SparkSession, d: str) -> DataFrame:
    odd = F.col("o_orderkey") % 4 == 0
    return table(spark, d, "orders").select(
        F.when(~odd, F.col("o_orderkey")).alias("key"), F.lit(None).cast("string").alias("blank"),
        F.when(~odd & (F.col("o_orderkey") % 3 != 0), F.col("o_orderstatus")).alias("status"),
    )


@query("drop_empty", """
SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS status FROM orders WHERE o_orderkey % 4 <> 0
""")
def drop_empty(spark: SparkSession, d: str) -> DataFrame:
    return clean.drop_empty(_with_holes(spark, d))


def _as_text(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = table(spark, d, name)
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def _long_text(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = _as_text(spark, d, name)
    return df.unpivot([], df.columns, "name", "value")


@query("infer_types", """
WITH long AS (UNPIVOT (SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus,
    o_totalprice::VARCHAR AS o_totalprice, o_orderdate::VARCHAR AS o_orderdate, o_orderpriority FROM orders)
  ON COLUMNS(*) INTO NAME name VALUE value)
SELECT name, COUNT(*) AS filled, CASE
  WHEN COUNT(*) FILTER (lower(value) IN ('true', 'false')) = COUNT(*) THEN 'BOOLEAN'
  WHEN COUNT(TRY_CAST(value AS BIGINT)) FILTER (regexp_full_match(value, '[-+]?[0-9]+')) = COUNT(*) THEN 'INTEGER'
  WHEN COUNT(TRY_CAST(value AS DOUBLE)) = COUNT(*) THEN 'DOUBLE PRECISION'
  WHEN COUNT(TRY_CAST(value AS TIMESTAMP)) = COUNT(*) THEN 'TIMESTAMP' ELSE 'TEXT' END AS type
FROM long GROUP BY 1
""")
def infer_types(spark: SparkSession, d: str) -> DataFrame:
    return profile.infer_types_by(_long_text(spark, d, "orders"), ["name"], "value")


def _contains_any(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in parts) + ")"


_NUM = "type IN ('DOUBLE PRECISION', 'INTEGER')"


def role_sql(x: str) -> str:
    return f"""CASE WHEN type = 'TIMESTAMP' OR {_contains_any(x, profile.DATE_PARTS)} THEN 'date'
  WHEN {_NUM} AND {_contains_any(x, profile.REVENUE_PARTS)} THEN 'revenue'
  WHEN {_NUM} AND {_contains_any(x, profile.EXPENSE_PARTS)} THEN 'expense'
  WHEN {_NUM} AND {_contains_any(x, profile.MONTH_PARTS)} THEN 'monthly_metric'
  WHEN {_NUM} AND {_contains_any(x, profile.NUMERIC_ID_PARTS)} THEN 'identifier'
  WHEN {_contains_any(x, profile.ID_PARTS)} THEN 'identifier' ELSE 'other' END"""


@query("column_roles", oracle("columns_v", body=f"SELECT id, name, {role_sql('lower(name)')} AS role FROM columns_v"))
def column_roles(spark: SparkSession, d: str) -> DataFrame:
    df = view(spark, d, "columns_v")
    return df.select("id", "name", profile.column_role(F.col("name"), F.col("type")).alias("role"))


@query("column_roles_csv", oracle("columns_v", body=f"""
SELECT id, name, CASE WHEN {_contains_any('lower(name)', profile.CSV_TIME_PARTS)} THEN 'dimension_time'
  WHEN {_contains_any('lower(name)', profile.CSV_KEY_PARTS)} THEN 'dimension_key'
  WHEN {_contains_any('lower(name)', profile.CSV_METRIC_PARTS)} THEN 'metric'
  WHEN {_NUM} THEN 'metric' ELSE 'dimension' END AS role FROM columns_v
"""))
def column_roles_csv(spark: SparkSession, d: str) -> DataFrame:
    df = view(spark, d, "columns_v")
    return df.select("id", "name", profile.column_role_csv(F.col("name"), F.col("type")).alias("role"))


@query("column_profile", """
WITH long AS (UNPIVOT (SELECT o_orderkey AS pos, o_custkey::VARCHAR AS o_custkey, o_orderstatus,
    substr(o_orderdate::VARCHAR, 1, 10) AS o_orderdate, o_orderpriority FROM orders)
  ON o_custkey, o_orderstatus, o_orderdate, o_orderpriority INTO NAME name VALUE value),
firsts AS (SELECT name, value, MIN(pos) AS pos FROM long GROUP BY 1, 2),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY name ORDER BY pos) AS rn FROM firsts),
kinds AS (SELECT name, CASE
  WHEN COUNT(TRY_CAST(value AS BIGINT)) FILTER (regexp_full_match(value, '[-+]?[0-9]+')) = COUNT(*) THEN 'INTEGER'
  WHEN COUNT(TRY_CAST(value AS DOUBLE)) = COUNT(*) THEN 'DOUBLE PRECISION'
  WHEN COUNT(TRY_CAST(value AS TIMESTAMP)) = COUNT(*) THEN 'TIMESTAMP' ELSE 'TEXT' END AS type FROM long GROUP BY 1),
named AS (SELECT k.name, k.type, s.samples FROM kinds k JOIN (SELECT name, string_agg(value, '|' ORDER BY rn) AS samples
  FROM ranked WHERE rn <= 3 GROUP BY 1) s ON s.name = k.name)
SELECT name, name AS original_name, type, samples, """ + role_sql("lower(name)") + """ AS role FROM named
""")
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"), "o_orderstatus",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority",
    )
    meta = profile.column_profile(df, ["o_orderkey"]).where("name <> 'o_orderkey'")
    return meta.select("name", "original_name", "type", F.array_join("samples", "|").alias("samples"), "role")


def _described(spark: SparkSession, d: str, n: int) -> DataFrame:
    """Sheets with the names of their first ``n`` columns in order and their sizes."""
    df = view(spark, d, "sheet_columns_v")
    return sheet_heads(df, n)


def sheet_heads(columns: DataFrame, n: int) -> DataFrame:
    """Per sheet: row and column counts and the first ``n`` column names.

    Only ``n`` columns of a sheet are brought together; the counts are aggregates.
    """
    from pyspark.sql.window import Window

    sizes = columns.groupBy("sheet").agg(
        F.sum("num_rows").alias("num_rows"), F.count(F.lit(1)).alias("num_columns")
    )
    rank = F.row_number().over(Window.partitionBy("sheet").orderBy("position"))
    heads = columns.withColumn("_rn", rank).where(F.col("_rn") <= n).groupBy("sheet").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rn", "name"))), lambda s: s["name"]).alias("columns")
    )
    return sizes.join(heads, "sheet")


_HEADS = """
WITH sizes AS (SELECT sheet, CAST(SUM(num_rows) AS BIGINT) AS num_rows, COUNT(*) AS num_columns FROM sheet_columns_v GROUP BY 1),
ranked AS (SELECT sheet, name, ROW_NUMBER() OVER (PARTITION BY sheet ORDER BY position) AS rn FROM sheet_columns_v),
ten AS (SELECT sheet, string_agg(name, ', ' ORDER BY rn) AS names FROM ranked WHERE rn <= 10 GROUP BY 1),
five AS (SELECT sheet, string_agg(name, ', ' ORDER BY rn) AS names FROM ranked WHERE rn <= 5 GROUP BY 1)
"""


@query("heuristic_summary", oracle("sheet_columns_v", body=_HEADS + """
SELECT s.sheet, 'Structured data table ''' || s.sheet || ''' containing columns: ' || t.names || '. '
  || CAST(s.num_rows AS VARCHAR) || ' rows.' AS summary, s.sheet || ', ' || f.names AS keywords
FROM sizes s JOIN ten t ON t.sheet = s.sheet JOIN five f ON f.sheet = s.sheet
"""))
def heuristic_summary(spark: SparkSession, d: str) -> DataFrame:
    return _described(spark, d, 10).select(
        "sheet", profile.heuristic_summary(F.col("sheet"), F.col("columns"), F.col("num_rows")).alias("summary"),
        profile.heuristic_keywords(F.col("sheet"), F.col("columns")).alias("keywords"),
    )


@query("fast_summary", oracle("sheet_columns_v", body=_HEADS + """
SELECT s.sheet, 'General' AS category, 'Sheet with ' || CAST(s.num_rows AS VARCHAR) || ' rows and '
  || CAST(s.num_columns AS VARCHAR) || ' columns' AS summary, f.names AS keywords
FROM sizes s JOIN five f ON f.sheet = s.sheet
"""))
def fast_summary(spark: SparkSession, d: str) -> DataFrame:
    return _described(spark, d, 5).select(
        "sheet", F.lit(profile.FAST_CATEGORY).alias("category"),
        profile.fast_summary(F.col("num_rows"), F.col("num_columns")).alias("summary"),
        profile.fast_keywords(F.col("columns")).alias("keywords"),
    )


def _with_meta(spark: SparkSession, d: str) -> DataFrame:
    """One sheet per part with two described columns."""
    def meta(name, original, dtype, samples):
        return F.struct(name.alias("name"), original.alias("original_name"), F.lit(dtype).alias("type"),
                        F.lit("other").alias("role"), samples.alias("samples"))

    text = F.col("p_partkey").cast("string")
    return table(spark, d, "part").select(
        F.col("p_name").alias("sheet"), F.col("p_partkey").alias("id"),
        F.array(
            meta(F.lit("brand"), F.lit("Brand"), "TEXT", F.array("p_brand", "p_type")),
            meta(F.lit("key"), F.lit("Key"), "INTEGER", F.array(text)),
        ).alias("columns_metadata"),
    )


@query("columns_text", """
SELECT p_partkey AS id, 'Sheet: ' || p_name || chr(10)
  || 'Column: brand (Original: Brand) - Samples: ' || p_brand || ', ' || p_type || chr(10)
  || 'Column: key (Original: Key) - Samples: ' || CAST(p_partkey AS VARCHAR) || chr(10) AS text FROM part
""")
def columns_text(spark: SparkSession, d: str) -> DataFrame:
    return _with_meta(spark, d).select("id", profile.columns_text(F.col("sheet"), F.col("columns_metadata")).alias("text"))


@query("meta_json", """
SELECT p_partkey AS id, 'brand' AS name, 'Brand' AS original_name, 'TEXT' AS type, p_brand || '|' || p_type AS samples
FROM part WHERE p_partkey % 10 <> 0
UNION ALL SELECT p_partkey, 'key', 'Key', 'INTEGER', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 10 <> 0
""")
def meta_json(spark: SparkSession, d: str) -> DataFrame:
    # Every tenth text is broken JSON and must read as an empty list.
    text = F.when(F.col("id") % 10 == 0, F.lit("[{")).otherwise(F.to_json("columns_metadata"))
    parsed = _with_meta(spark, d).select("id", parse_columns_metadata(text, COLUMN_META).alias("m"))
    return parsed.select("id", F.explode("m").alias("c")).select(
        "id", "c.name", "c.original_name", "c.type", F.array_join("c.samples", "|").alias("samples")
    )
