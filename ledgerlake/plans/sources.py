"""Source queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path
from ..sources import files as fs
from .registry import query
from .views import oracle, table, view


@query("src_csv", """
SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal,
  CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer
""")
def src_csv(spark: SparkSession, d: str) -> DataFrame:
    """Customers written as CSV with some missing-value texts, read back and typed."""
    path = new_path(spark, "csv")
    missing = F.when(F.col("c_custkey") % 6 == 0, "N/A").otherwise(F.col("c_mktsegment"))
    table(spark, d, "customer").withColumn("c_mktsegment", missing).write.csv(path, header=True)
    return fs.read_csv(spark, path)


@query("src_csv_multiline", """
SELECT doc_id, CASE WHEN text NOT IN ('NA', 'None', 'null') THEN text END AS text, source FROM (
  SELECT doc_id, trim(replace(text, chr(13), ' ')) AS text, source FROM documents) WHERE text <> ''
""")
def src_csv_multiline(spark: SparkSession, d: str) -> DataFrame:
    """Documents of many lines written as one column of a CSV table, read back."""
    path = new_path(spark, "csv-lines")
    text = F.trim(F.replace("text", F.lit("\r"), F.lit(" "))).alias("text")
    docs = table(spark, d, "documents", heavy=True).select("doc_id", text, "source").where("text <> ''")
    docs.write.option("escape", '"').csv(path, header=True)
    return fs.read_csv(spark, path, "doc_id long, text string, source string")


def _contents(spark: SparkSession, d: str) -> DataFrame:
    """Document files in the form the binary reader gives; some blank, some in a single-byte encoding."""
    doc = F.col("doc_id")
    text = F.when(doc % 50 == 0, " \n\t").otherwise(F.col("text"))
    utf8 = F.encode(text, "UTF-8")
    single = F.encode(F.translate(F.regexp_replace(text, r"[^\x00-\x7f]", "é"), "", ""), "ISO-8859-1")
    return table(spark, d, "documents", heavy=True).select(
        doc.alias("doc_id"), F.concat(F.lit("/in/"), doc.cast("string"), F.lit(".txt")).alias("path"),
        F.when(doc % 7 == 3, single).otherwise(utf8).alias("content"),
    ).withColumn("length", F.length("content"))


_TEXT = "CASE WHEN doc_id % 50 = 0 THEN ' ' || chr(10) || chr(9) ELSE text END"
_DECODED = f"CASE WHEN doc_id % 7 = 3 THEN regexp_replace({_TEXT}, '[^\\x00-\\x7f]', 'é', 'g') ELSE {_TEXT} END"


@query("src_text_status", rf"""
SELECT doc_id, md5(t) AS text_md5, CASE WHEN regexp_matches(t, '^\s*$') THEN 'EMPTY' ELSE 'SUCCESS' END AS status
FROM (SELECT doc_id, {_DECODED} AS t FROM documents)
""")
def src_text_status(spark: SparkSession, d: str) -> DataFrame:
    return fs.text_status(_contents(spark, d)).select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"), "status")


@query("src_encoding", rf"""
SELECT doc_id, CASE WHEN doc_id % 7 = 3 AND regexp_matches({_TEXT}, '[^\x00-\x7f]') THEN 'ISO-8859-1' ELSE 'UTF-8' END AS encoding FROM documents
""")
def src_encoding(spark: SparkSession, d: str) -> DataFrame:
    return _contents(spark, d).select("doc_id", fs.pick_encoding(F.col("content")).alias("encoding"))


@query("content_hash", "SELECT doc_id, md5(text) AS file_hash FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", heavy=True).select("doc_id", fs.content_hash(F.encode("text", "UTF-8")).alias("file_hash"))


_KIND = """CASE WHEN lower(file_name) LIKE '%.xlsx' OR lower(file_name) LIKE '%.xls' THEN 'excel'
  WHEN lower(file_name) LIKE '%.csv' THEN 'csv' WHEN lower(file_name) LIKE '%.pdf' THEN 'pdf' WHEN lower(file_name) LIKE '%.txt' THEN 'text'
  WHEN lower(file_name) LIKE '%.doc' OR lower(file_name) LIKE '%.docx' THEN 'word' ELSE 'unknown' END"""


@query("route_types", oracle("files_v", body=f"SELECT {_KIND} AS file_type, COUNT(*) AS n FROM files_v GROUP BY 1"))
def route_types(spark: SparkSession, d: str) -> DataFrame:
    kinds = view(spark, d, "files_v").select(fs.file_kind(F.col("file_name")).alias("file_type"))
    return kinds.groupBy("file_type").agg(F.count(F.lit(1)).alias("n"))


@query("batch_files", oracle("files_v", body=f"""
SELECT file_id, {_KIND} AS file_type, CASE WHEN {_KIND} = 'unknown' OR length > 52428800 THEN 'FAILED' ELSE 'SUCCESS' END AS status,
  CASE WHEN {_KIND} = 'unknown' THEN 'Invalid file type' WHEN length > 52428800 THEN 'File too large' ELSE 'Success' END AS message
FROM files_v
"""))
def batch_files(spark: SparkSession, d: str) -> DataFrame:
    files = view(spark, d, "files_v").withColumnRenamed("file_name", "path")
    return fs.scan_status(files).select("file_id", "file_type", "status", "message")


@query("batch_status", oracle("files_v", body=f"""
SELECT COUNT(*) AS total_files, COUNT(*) FILTER (NOT bad) AS successful, COUNT(*) FILTER (bad) AS failed
FROM (SELECT {_KIND} = 'unknown' OR length > 52428800 AS bad FROM files_v)
"""))
def batch_status(spark: SparkSession, d: str) -> DataFrame:
    return fs.batch_totals(fs.scan_status(view(spark, d, "files_v").withColumnRenamed("file_name", "path")))
