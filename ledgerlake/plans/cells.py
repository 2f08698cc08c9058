"""Queries over sheet grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import cells as c
from ..operators import warehouse
from ..operators.ingest import ingest, ingest_cells
from ..operators.profile import SPARK_TYPES, infer_types_by
from ..sources.files import csv_to_cells
from ..session import cut, new_path
from .names import name_sql, role_sql
from .registry import query
from .views import oracle, table, view

KEYS = ["sheet"]

# Labels by recursion over touching cells. A group's first cell reaches every member
# through cells that are not smaller than itself, which bounds the recursion.
DETECT_CTES = """
WITH reach(sheet, r, c, r0, c0) AS (
  SELECT sheet, r, c, r, c FROM grid_v
  UNION
  SELECT n.sheet, n.r, n.c, a.r0, a.c0 FROM reach a JOIN grid_v n ON n.sheet = a.sheet
   AND n.r BETWEEN a.r - 1 AND a.r + 1 AND n.c BETWEEN a.c - 1 AND a.c + 1 WHERE (a.r0, a.c0) <= (n.r, n.c)),
lab AS (SELECT sheet, r, c, min((r0, c0)) AS m FROM reach GROUP BY 1, 2, 3),
boxes AS (SELECT sheet, m, MIN(r) AS r0, MAX(r) AS r1, MIN(c) AS c0, MAX(c) AS c1, COUNT(*) AS n_cells FROM lab GROUP BY 1, 2),
tables AS (SELECT sheet, r0, r1, c0, c1, n_cells, ROW_NUMBER() OVER (PARTITION BY sheet ORDER BY m) AS table_no
  FROM boxes WHERE (r1 - r0 + 1) * (c1 - c0 + 1) > 1),
inside AS (SELECT t.*, g.r AS row, g.c AS col, g.value FROM tables t JOIN grid_v g
  ON g.sheet = t.sheet AND g.r BETWEEN t.r0 AND t.r1 AND g.c BETWEEN t.c0 AND t.c1),
promoted AS (SELECT d.sheet, d.table_no, d.row - d.r0 - 1 AS data_row, d.col, h.value AS header, d.value
  FROM inside d LEFT JOIN inside h ON h.sheet = d.sheet AND h.table_no = d.table_no AND h.col = d.col AND h.row = h.r0
  WHERE d.row > d.r0)
"""


def _sql(body: str) -> str:
    return oracle("grid_v", recursive=True, body=DETECT_CTES + body)


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return _written(view(spark, d, "grid_v", heavy=True))


def _written(grid: DataFrame) -> DataFrame:
    """The cells of a view, which is read more than once and costs a shuffle of its input each time."""
    return cut(grid.select("sheet", F.col("r").alias("row"), F.col("c").alias("col"), "value"))


@query("detect_tables", _sql(" SELECT sheet, r0, r1, c0, c1, n_cells, table_no FROM tables"))
def detect_tables(spark: SparkSession, d: str) -> DataFrame:
    return c.detect_tables(c.nonblank(_grid(spark, d)), KEYS)


@query("detect_tables_all", _sql(" SELECT sheet, r0, r1, c0, c1, n_cells FROM boxes"))
def detect_tables_all(spark: SparkSession, d: str) -> DataFrame:
    return c.detect_tables(c.nonblank(_grid(spark, d)), KEYS, min_area=1, number=False)


def _inside(spark: SparkSession, d: str) -> DataFrame:
    grid = c.nonblank(_grid(spark, d))
    return c.table_cells(grid, c.detect_tables(grid, KEYS), KEYS)


@query("table_cells", _sql(" SELECT sheet, table_no, row, col, value FROM inside"))
def table_cells(spark: SparkSession, d: str) -> DataFrame:
    return _inside(spark, d).select("sheet", "table_no", "row", "col", "value")


@query("header_promote", _sql(" SELECT sheet, table_no, data_row, col, header, value FROM promoted"))
def header_promote(spark: SparkSession, d: str) -> DataFrame:
    return c.promote_header(_inside(spark, d), KEYS)


@query("detected_columns", _sql(f"""
SELECT sheet, table_no, position, CASE WHEN nth = 0 THEN norm ELSE norm || '_' || CAST(nth AS VARCHAR) END AS final_name FROM (
  SELECT sheet, table_no, position, norm, ROW_NUMBER() OVER (PARTITION BY sheet, table_no, norm ORDER BY position) - 1 AS nth
  FROM (SELECT sheet, table_no, col - c0 AS position, {name_sql('value')} AS norm FROM inside WHERE row = r0))
"""))
def detected_columns(spark: SparkSession, d: str) -> DataFrame:
    head = cut(c.header_cells(_inside(spark, d), KEYS).withColumn("norm", names.normalize_name(F.col("header"))))
    named = names.dedup_names(head, ["sheet", "table_no"], "position", "norm")
    return named.select("sheet", "table_no", "position", "final_name")


@query("detected_types", _sql("""
SELECT sheet, table_no, col, COUNT(value) AS filled,
  CASE WHEN COUNT(TRY_CAST(value AS BIGINT)) = COUNT(value) THEN 'INTEGER' ELSE 'TEXT' END AS type
FROM promoted GROUP BY 1, 2, 3
"""))
def detected_types(spark: SparkSession, d: str) -> DataFrame:
    return infer_types_by(c.promote_header(_inside(spark, d), KEYS), ["sheet", "table_no", "col"], "value")


@query("cells_to_table", oracle("grid_v", body="""
SELECT sheet, r AS row, """ + ", ".join(
    f"MAX(CASE WHEN c = {i} THEN CAST(value AS BIGINT) END) AS c{i}" for i in range(12)
) + " FROM grid_v GROUP BY 1, 2"))
def cells_to_table(spark: SparkSession, d: str) -> DataFrame:
    columns = {i: (f"c{i}", SPARK_TYPES["INTEGER"]) for i in range(12)}
    return c.cells_to_table(_grid(spark, d), ["sheet", "row"], columns)


@query("table_names", _sql("""
SELECT sheet, table_no, clean_name,
  'sheet_' || trim(regexp_replace(lower(clean_name), '[^a-z0-9]+', '_', 'g'), '_') || '_' || substr(md5(sheet), 1, 8) AS main_name,
  'data_' || substr(md5(sheet), 1, 8) || '_' || trim(lower(clean_name), '_') AS csv_name,
  'word_table_' || substr(md5(sheet), 1, 8) || '_' || CAST(table_no AS VARCHAR) AS word_name
FROM (SELECT sheet, table_no, CASE WHEN COUNT(*) OVER (PARTITION BY sheet) > 1
  THEN sheet || '_Table' || CAST(table_no AS VARCHAR) ELSE sheet END AS clean_name FROM tables)
"""))
def table_names(spark: SparkSession, d: str) -> DataFrame:
    tables = c.detect_tables(c.nonblank(_grid(spark, d)), KEYS)
    file_id = F.md5(F.col("sheet").cast("binary"))
    named = c.table_names(tables, KEYS, "sheet")
    return named.select(
        "sheet", "table_no", "clean_name",
        names.sheet_table_name(F.col("clean_name"), file_id).alias("main_name"),
        names.csv_table_name(F.col("clean_name"), file_id).alias("csv_name"),
        names.word_table_name(F.col("table_no"), file_id).alias("word_name"),
    )


@query("src_cells", """
WITH t AS (SELECT CAST(p_partkey AS VARCHAR) AS key, p_name, p_brand, CASE WHEN p_size % 3 = 0 THEN '   ' ELSE p_type END AS kind,
  CAST(p_size AS VARCHAR) AS size FROM part)
SELECT key, 1 AS col, p_name AS value FROM t UNION ALL SELECT key, 2, p_brand FROM t
UNION ALL SELECT key, 4, kind FROM t WHERE trim(kind) <> '' UNION ALL SELECT key, 5, size FROM t
""")
def src_cells(spark: SparkSession, d: str) -> DataFrame:
    """Grids written as CSV lines with blank cells, read back; the first cell names the line."""
    path = new_path(spark, "grids")
    line = F.concat_ws(
        ",", F.col("p_partkey").cast("string"), F.concat(F.lit('"'), "p_name", F.lit('"')), "p_brand", F.lit(""),
        F.when(F.col("p_size") % 3 == 0, "   ").otherwise(F.col("p_type")), F.col("p_size").cast("string"),
    )
    table(spark, d, "part").select(line.alias("value")).write.text(path)
    cells = csv_to_cells(spark, path)
    keys = cells.where("col = 0").select("file_id", "row", F.col("value").alias("key"))
    return cells.where("col > 0").join(keys, ["file_id", "row"]).select("key", "col", "value")


@query("src_cells_multiline", """
WITH t AS (SELECT CAST(p_partkey AS VARCHAR) AS key, p_partkey % 3 AS kind, p_name, p_brand, p_type FROM part)
SELECT key, 1 AS col, p_name || chr(10) || '"' || p_brand || '",' || chr(10) AS value FROM t WHERE kind > 0
UNION ALL SELECT key, 1, p_name FROM t WHERE kind = 0 UNION ALL SELECT key, 3, p_type || CASE kind WHEN 2 THEN chr(10) || key ELSE '' END FROM t
""")
def src_cells_multiline(spark: SparkSession, d: str) -> DataFrame:
    """Grids whose cells hold line breaks, commas and quotes, written as CSV lines and read back; the first cell names the record."""
    path = new_path(spark, "grids-lines")
    kind = F.col("p_partkey") % 3
    first = F.when(kind > 0, F.concat(F.lit('"'), "p_name", F.lit('\n""'), "p_brand", F.lit('"",\n"'))).otherwise(F.col("p_name"))
    last = F.when(kind == 2, F.concat(F.lit('"'), "p_type", F.lit("\n"), F.col("p_partkey").cast("string"), F.lit('"'))).otherwise(F.col("p_type"))
    table(spark, d, "part").select(F.concat_ws(",", F.col("p_partkey").cast("string"), first, F.lit(""), last).alias("value")).write.text(path)
    cells = csv_to_cells(spark, path)
    keys = cells.where("col = 0").select("file_id", "row", F.col("value").alias("key"))
    return cells.where("col > 0").join(keys, ["file_id", "row"]).select("key", "col", "value")


INGEST_CTES = f""",
columns AS (SELECT sheet, table_no, col, MAX(CASE WHEN row = r0 THEN value END) AS original_name,
    COUNT(CASE WHEN row > r0 THEN value END) AS filled,
    COUNT(CASE WHEN row > r0 THEN TRY_CAST(value AS BIGINT) END) AS whole FROM inside GROUP BY 1, 2, 3),
normed AS (SELECT *, CASE WHEN whole = filled THEN 'INTEGER' ELSE 'TEXT' END AS type, {name_sql('original_name')} AS norm
  FROM columns WHERE filled > 0),
named AS (SELECT *, CASE WHEN nth = 0 THEN norm ELSE norm || '_' || CAST(nth AS VARCHAR) END AS name FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY sheet, table_no, norm ORDER BY col) - 1 AS nth FROM normed)),
firsts AS (SELECT sheet, table_no, col, value, MIN(row) AS first_row FROM inside WHERE row > r0 GROUP BY 1, 2, 3, 4),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY sheet, table_no, col ORDER BY first_row) AS rn FROM firsts),
samples AS (SELECT sheet, table_no, col, string_agg(value, '|' ORDER BY rn) AS samples FROM ranked WHERE rn <= 3 GROUP BY 1, 2, 3)
"""


def _ingested(spark: SparkSession, d: str):
    return ingest(_grid(spark, d), KEYS, "sheet", F.md5(F.col("sheet").cast("binary")))


@query("ingest_columns", _sql(INGEST_CTES + f"""
SELECT n.sheet, n.table_no, n.col, n.original_name, n.name, n.type, {role_sql('lower(n.name)')} AS role, s.samples
FROM named n JOIN samples s ON s.sheet = n.sheet AND s.table_no = n.table_no AND s.col = n.col
"""))
def ingest_columns(spark: SparkSession, d: str) -> DataFrame:
    columns = _ingested(spark, d)[1]
    return columns.select(
        "sheet", "table_no", "col", "original_name", "name", "type", "role", F.array_join("samples", "|").alias("samples")
    )


@query("ingest_sheets", _sql(INGEST_CTES + """,
widths AS (SELECT sheet, table_no, COUNT(*) AS num_columns, string_agg(name, ', ' ORDER BY col) FILTER (pos <= 5) AS keywords
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sheet, table_no ORDER BY col) AS pos FROM named) GROUP BY 1, 2),
titled AS (SELECT *, CASE WHEN COUNT(*) OVER (PARTITION BY sheet) > 1 THEN sheet || '_Table' || CAST(table_no AS VARCHAR) ELSE sheet END AS title
  FROM tables)
SELECT t.sheet, t.table_no, t.title AS sheet_title,
  'sheet_' || trim(regexp_replace(lower(t.title), '[^a-z0-9]+', '_', 'g'), '_') || '_' || substr(md5(t.sheet), 1, 8) AS table_name,
  t.r1 - t.r0 AS num_rows, CAST(w.num_columns AS INTEGER) AS num_columns, 'General' AS category,
  'Sheet with ' || CAST(t.r1 - t.r0 AS VARCHAR) || ' rows and ' || CAST(w.num_columns AS VARCHAR) || ' columns' AS summary, w.keywords
FROM titled t JOIN widths w ON w.sheet = t.sheet AND w.table_no = t.table_no
"""))
def ingest_sheets(spark: SparkSession, d: str) -> DataFrame:
    return _ingested(spark, d)[2].drop("columns_metadata")


def _mixed(body: str) -> str:
    """The same oracle over the mixed grid, with decimals as a type."""
    whole = "TRY_CAST(CASE WHEN value NOT LIKE '%.%' THEN value END AS BIGINT)"
    ctes = (DETECT_CTES + INGEST_CTES).replace("grid_v", "mixed_v").replace("TRY_CAST(value AS BIGINT)", whole).replace("AS whole FROM", """AS whole,
    COUNT(CASE WHEN row > r0 THEN TRY_CAST(value AS DOUBLE) END) AS num FROM""").replace(
        "'INTEGER' ELSE", "'INTEGER' WHEN num = filled THEN 'DOUBLE PRECISION' ELSE")
    titled = """,
titled AS (SELECT sheet, table_no, r0, r1, CASE WHEN COUNT(*) OVER (PARTITION BY sheet) > 1 THEN sheet || '_Table' || CAST(table_no AS VARCHAR)
  ELSE sheet END AS title FROM tables),
tabled AS (SELECT *, 'sheet_' || trim(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '_') || '_' || substr(md5(sheet), 1, 8) AS table_name
  FROM titled)"""
    return oracle("mixed_v", recursive=True, body=ctes + titled + body)


def _mixed_ingest(spark: SparkSession, d: str):
    return ingest_cells(_written(view(spark, d, "mixed_v", heavy=True)), KEYS, "sheet", _file_id())


def _file_id():
    return F.md5(F.col("sheet").cast("binary"))


@query("ingest_catalog", _mixed("""
SELECT t.sheet AS file_name, md5(t.sheet) AS file_id, md5(md5(t.sheet) || chr(31) || t.sheet || chr(31) || CAST(t.table_no AS VARCHAR)) AS sheet_id,
  t.title AS sheet_name, t.table_name, t.r1 - t.r0 AS num_rows, w.columns, 'finance' AS data_domain, 'internal' AS sensitivity_level,
  CAST(COUNT(*) OVER (PARTITION BY t.sheet) AS INTEGER) AS num_sheets
FROM tabled t JOIN (SELECT sheet, table_no, string_agg(name || ':' || type, ',' ORDER BY col) AS columns FROM named GROUP BY 1, 2) w
  ON w.sheet = t.sheet AND w.table_no = t.table_no"""))
def ingest_catalog(spark: SparkSession, d: str) -> DataFrame:
    """File and sheet rows of a batch in the catalogue's shapes, appended and read back."""
    sheets = cut(_mixed_ingest(spark, d)[3])
    rows = warehouse.sheet_rows(sheets, _file_id(), KEYS, "finance", "internal")
    files = sheets.select("sheet").distinct().select(
        _file_id().alias("file_id"), F.col("sheet").alias("file_name"), F.lit(".csv").alias("file_type"), F.lit(1).alias("version"))
    at = [new_path(spark, n) for n in ("sheets", "files")]
    rows.write.mode("append").parquet(at[0])
    rows = spark.read.schema(rows.schema).parquet(at[0])
    files = warehouse.file_rows(files, rows)
    files.write.mode("append").parquet(at[1])
    files = spark.read.schema(files.schema).parquet(at[1])
    columns = F.array_join(F.transform("columns_metadata", lambda m: F.concat(m["name"], F.lit(":"), m["type"])), ",")
    return rows.join(files.select("file_id", "file_name", "num_sheets"), "file_id").select(
        "file_name", "file_id", "sheet_id", "sheet_name", "table_name", "num_rows", columns.alias("columns"), "data_domain",
        "sensitivity_level", "num_sheets",
    )


@query("ingest_tables", _mixed("""
SELECT t.table_name, i.row - i.r0 - 1 AS row, n.name, i.value
FROM inside i JOIN tabled t ON t.sheet = i.sheet AND t.table_no = i.table_no
JOIN named n ON n.sheet = i.sheet AND n.table_no = i.table_no AND n.col = i.col WHERE i.row > i.r0"""))
def ingest_tables(spark: SparkSession, d: str) -> DataFrame:
    """The cells of all data tables of a batch, written in one job and read back."""
    _, inside, columns, sheets = _mixed_ingest(spark, d)
    path = new_path(spark, "data")
    warehouse.write_data(warehouse.data_rows(inside, columns, sheets, KEYS), path)
    return warehouse.read_rows(spark, path).select("table_name", "row", F.explode("cells").alias("name", "value"))
