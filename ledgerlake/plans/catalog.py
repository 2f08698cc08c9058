"""Catalogue queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import sheet_table_name
from ..operators import catalog as cat
from ..operators.buckets import BucketStore, delete_files
from ..operators.profile import csv_file_keywords, csv_file_summary
from ..session import new_path
from ..sources.files import extension
from ..sources.tables import append_table, read_table
from .registry import query
from .views import oracle, table, view


def _store(spark: SparkSession, rows: DataFrame, key: str) -> BucketStore:
    """``rows`` as a stored table in buckets of ``key``."""
    store = BucketStore(spark, new_path(spark, "store"), rows.schema, key)
    store.append(rows)
    return store


def _day(name: str):
    return F.date_format(name, "yyyy-MM-dd")


@query("catalog_files", oracle("files_v", body="""
SELECT file_id, file_name, strftime(uploaded_at, '%Y-%m-%d') AS uploaded_at, num_sheets, num_pages, summary, keywords, file_hash FROM files_v
"""))
def catalog_files(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "files_v").select(
        F.col("file_id").cast("string").alias("file_id"), "file_name", _day("uploaded_at").alias("uploaded_at"),
        "num_sheets", "num_pages", "summary", "keywords", "file_hash",
    )


@query("catalog_page", oracle("files_v", body="""
SELECT file_id, file_name, strftime(uploaded_at, '%Y-%m-%d') AS uploaded_at FROM files_v
ORDER BY files_v.uploaded_at DESC, file_id LIMIT 100 OFFSET 200
"""))
def catalog_page(spark: SparkSession, d: str) -> DataFrame:
    page = cat.list_files(view(spark, d, "files_v"), 100, 200)
    return page.select("file_id", "file_name", _day("uploaded_at").alias("uploaded_at"))


@query("file_detail", oracle("files_v", "sheets_v", body="""
SELECT f.file_id, f.file_name, s.sheet_id, s.sheet_name, s.num_rows, s.category
FROM files_v f LEFT JOIN sheets_v s ON s.file_id = f.file_id WHERE f.file_id = 'f7'
"""))
def file_detail(spark: SparkSession, d: str) -> DataFrame:
    sheets = view(spark, d, "sheets_v").select("file_id", "sheet_id", "sheet_name", "num_rows", "category")
    detail = cat.file_detail(view(spark, d, "files_v"), sheets, "f7")
    return detail.select("file_id", "file_name", "sheet_id", "sheet_name", "num_rows", "category")


@query("sheet_by_id", oracle("sheets_v", body="""
SELECT sheet_id, file_id, sheet_name, table_name, num_rows, num_columns, category, summary, keywords FROM sheets_v WHERE sheet_id = 's42'
"""))
def sheet_by_id(spark: SparkSession, d: str) -> DataFrame:
    return cat.sheet_by_id(view(spark, d, "sheets_v"), "s42").select(
        "sheet_id", "file_id", "sheet_name", "table_name", "num_rows", "num_columns", "category", "summary", "keywords"
    )


@query("sheets_explorer", oracle("sheets_v", "files_v", body="""
SELECT s.sheet_id, f.file_name, s.sheet_name, s.table_name, s.num_rows, s.num_columns, s.summary,
  COALESCE(s.category, 'Uncategorized') AS category, s.keywords
FROM sheets_v s JOIN files_v f ON f.file_id = s.file_id ORDER BY f.uploaded_at DESC, s.sheet_name
"""))
def sheets_explorer(spark: SparkSession, d: str) -> DataFrame:
    return cat.sheets_explorer(view(spark, d, "sheets_v"), view(spark, d, "files_v")).select(
        "sheet_id", "file_name", "sheet_name", "table_name", "num_rows", "num_columns", "summary", "category", "keywords"
    )


@query("catalog_stats", oracle("files_v", "sheets_v", "chunks_v", body="""
SELECT (SELECT COUNT(*) FROM files_v) AS total_files, (SELECT COUNT(*) FROM sheets_v) AS total_sheets,
  (SELECT CAST(COALESCE(SUM(num_rows), 0) AS BIGINT) FROM sheets_v) AS total_rows,
  (SELECT COUNT(*) FROM chunks_v WHERE kind = 'pdf') AS total_pdf_chunks
"""))
def catalog_stats(spark: SparkSession, d: str) -> DataFrame:
    return cat.catalog_stats(view(spark, d, "files_v"), view(spark, d, "sheets_v"), view(spark, d, "chunks_v"))


@query("catalog_build", oracle("files_v", body="""
SELECT file_id, CASE WHEN instr(file_name, '.') > 0 THEN lower('.' || split_part(file_name, '.', -1)) ELSE '' END AS ext,
  'Financial file ''' || file_name || ''' containing 1 sheets: main.' AS summary,
  'finance, ' || CASE WHEN instr(file_name, '.') > 0 THEN lower('.' || split_part(file_name, '.', -1)) ELSE '' END || ', ' || file_name AS keywords,
  'sheet_main_' || substr(file_hash, 1, 8) AS table_name FROM files_v
"""))
def catalog_build(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue rows of one-sheet files, appended to a table and read back."""
    ext = extension(F.col("file_name"))
    rows = view(spark, d, "files_v").select(
        "file_id", ext.alias("ext"), csv_file_summary(F.col("file_name"), F.array(F.lit("main"))).alias("summary"),
        csv_file_keywords(ext, F.col("file_name")).alias("keywords"),
        sheet_table_name(F.lit("main"), F.col("file_hash")).alias("table_name"),
    )
    path = new_path(spark, "catalog")
    rows.write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@query("catalog_update", oracle("sheets_v", body="""
SELECT sheet_id, CASE WHEN vec % 2 = 0 THEN 'New ' || sheet_name ELSE category END AS category,
  CASE WHEN vec % 2 = 0 AND vec % 3 <> 0 THEN 'updated' ELSE keywords END AS keywords
FROM (SELECT *, CAST(substr(sheet_id, 2) AS BIGINT) AS vec FROM sheets_v)
"""))
def catalog_update(spark: SparkSession, d: str) -> DataFrame:
    sheets = view(spark, d, "sheets_v").select("sheet_id", "sheet_name", "category", "keywords")
    vec = F.substring("sheet_id", 2, 20).cast("bigint")
    changes = sheets.select(
        "sheet_id", F.when(vec % 2 == 0, F.concat(F.lit("New "), "sheet_name")).alias("category"),
        F.when((vec % 2 == 0) & (vec % 3 != 0), "updated").alias("keywords"),
    )
    return cat.update_by_key(sheets, changes, "sheet_id").drop("sheet_name")


@query("cascade_delete", oracle("files_v", "sheets_v", "chunks_v", body="""
WITH gone AS (SELECT file_id FROM files_v WHERE num_sheets = 3)
SELECT 'file' AS kind, file_id AS id FROM files_v WHERE file_id NOT IN (SELECT file_id FROM gone)
UNION ALL SELECT 'sheet', sheet_id FROM sheets_v WHERE file_id NOT IN (SELECT file_id FROM gone)
UNION ALL SELECT 'chunk', chunk_id FROM chunks_v WHERE file_id NOT IN (SELECT file_id FROM gone)
UNION ALL SELECT 'drop', table_name FROM sheets_v WHERE file_id IN (SELECT file_id FROM gone)
"""))
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    files = view(spark, d, "files_v")
    f, s, c, drops = cat.cascade_delete(
        files, view(spark, d, "sheets_v"), view(spark, d, "chunks_v"), files.where("num_sheets = 3")
    )

    def part(df: DataFrame, kind: str, col: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col(col).alias("id"))

    return part(f, "file", "file_id").unionByName(part(s, "sheet", "sheet_id")).unionByName(
        part(c, "chunk", "chunk_id")).unionByName(part(drops, "drop", "table_name"))


_UPDATED = """
SELECT sheet_id, file_id, CASE WHEN vec % 50 = 0 THEN 'New ' || sheet_name ELSE category END AS category,
  CASE WHEN vec % 150 = 0 THEN 'updated' ELSE keywords END AS keywords
FROM (SELECT *, CAST(substr(sheet_id, 2) AS BIGINT) AS vec FROM sheets_v)
"""


@query("catalog_update_stored", oracle("sheets_v", body=_UPDATED))
def catalog_update_stored(spark: SparkSession, d: str) -> DataFrame:
    """Every fiftieth sheet changes where it is stored; buckets without a change keep their files."""
    sheets = view(spark, d, "sheets_v").select("sheet_id", "file_id", "sheet_name", "category", "keywords")
    store = _store(spark, sheets, "file_id")
    vec = F.substring("sheet_id", 2, 20).cast("bigint")
    store.update(sheets.where(vec % 50 == 0).select(
        "sheet_id", F.concat(F.lit("New "), "sheet_name").alias("category"), F.when(vec % 150 == 0, "updated").alias("keywords"),
    ), "sheet_id")
    return store.read().drop("sheet_name")


@query("cascade_delete_stored", oracle("files_v", "sheets_v", "chunks_v", body="""
WITH gone AS (SELECT file_id FROM files_v WHERE num_sheets = 3)
SELECT 'file' AS kind, file_id AS id FROM files_v WHERE file_id NOT IN (SELECT file_id FROM gone)
UNION ALL SELECT 'sheet', sheet_id FROM sheets_v WHERE file_id NOT IN (SELECT file_id FROM gone)
UNION ALL SELECT 'chunk', chunk_id FROM chunks_v WHERE file_id NOT IN (SELECT file_id FROM gone)
"""))
def cascade_delete_stored(spark: SparkSession, d: str) -> DataFrame:
    """Files of three sheets go from the stored catalogue with all that depends on them."""
    ids = {"file": "file_id", "sheet": "sheet_id", "chunk": "chunk_id"}
    files = view(spark, d, "files_v")
    stores = {k: _store(spark, view(spark, d, f"{k}s_v").select(*dict.fromkeys(["file_id", i])), "file_id") for k, i in ids.items()}
    delete_files(stores["file"], stores["sheet"], stores["chunk"], files.where("num_sheets = 3").select("file_id"))
    parts = [stores[k].read().select(F.lit(k).alias("kind"), F.col(i).alias("id")) for k, i in ids.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("validate_catalog", oracle("files_v", "sheets_v", "chunks_v", "policies_v", body="""
SELECT (SELECT COUNT(*) FROM files_v) AS files_count, (SELECT COUNT(*) FROM sheets_v) AS sheets_count,
  (SELECT COUNT(*) FROM sheets_v WHERE file_id NOT IN (SELECT file_id FROM files_v)) AS orphan_sheets,
  (SELECT COUNT(*) FROM chunks_v WHERE file_id NOT IN (SELECT file_id FROM files_v)) AS orphan_chunks,
  CAST(0 AS BIGINT) AS duplicate_policies,
  (SELECT COUNT(*) FROM sheets_v s WHERE data_domain IS NOT NULL AND sensitivity_level IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM policies_v p WHERE p.allowed AND p.data_domain = s.data_domain AND p.sensitivity_level = s.sensitivity_level)) AS unseen_sheets,
  false AS is_healthy
"""))
def validate_catalog(spark: SparkSession, d: str) -> DataFrame:
    return cat.validate(
        view(spark, d, "files_v"), view(spark, d, "sheets_v"), view(spark, d, "chunks_v"), view(spark, d, "policies_v")
    )


VERSION_CTES = """
WITH marked AS (SELECT *, CASE WHEN file_hash = LAG(file_hash) OVER (PARTITION BY file_name ORDER BY arrival) THEN 0 ELSE 1 END AS new FROM versions_v),
versions AS (SELECT file_name, arrival, file_hash, CASE new WHEN 1 THEN 'NEW' ELSE 'DUPLICATE' END AS status,
  CAST(SUM(new) OVER (PARTITION BY file_name ORDER BY arrival) AS BIGINT) AS version FROM marked)
"""


@query("file_versions", oracle("versions_v", body=VERSION_CTES + " SELECT * FROM versions"))
def file_versions(spark: SparkSession, d: str) -> DataFrame:
    return cat.assign_versions(view(spark, d, "versions_v"))


@query("latest_version", oracle("versions_v", body=VERSION_CTES + """
SELECT file_name, MAX(version) AS version, arg_max(file_hash, version) AS file_hash FROM versions WHERE status = 'NEW' GROUP BY 1
"""))
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    new = cat.assign_versions(view(spark, d, "versions_v")).where("status = 'NEW'")
    return cat.latest_version(new.select("file_name", "version", "file_hash"))


@query("table_select", "SELECT o_orderkey, o_totalprice FROM orders")
def table_select(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "orders").createOrReplaceTempView("sheet_orders")
    return read_table(spark, "sheet_orders", ["o_orderkey", "o_totalprice"])


@query("sink_roundtrip", """
SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS c_acctbal FROM customer
""")
def sink_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Two appends to one table; NaN comes back as null."""
    path = new_path(spark, "sink")
    name = "data_" + path[-32:]
    df = table(spark, d, "customer").select(
        "c_custkey", "c_name",
        F.when(F.col("c_custkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
    )
    append_table(df.where("c_acctbal > 0"), name, path)
    append_table(df.where("not c_acctbal > 0"), name, path)
    return spark.table(name)
