"""Writing what ingestion finds: catalogue rows, data tables and chunks, in the shapes of ``schemas``.

The data tables of a batch are one Parquet table with the cells of a row as a map from column name to text, however many tables there
are. It is clustered: rows lie in hash buckets of table names, sorted by table and row. A reader names a table, which prunes all other
buckets by their folder and all other files and row groups by their statistics, and gets its typed columns from the catalogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import chunk_rows, entities, fixed_chunks, pages_to_rows, strip_nul
from ..schemas import CHUNKS, FILES, SHEETS
from .profile import SPARK_TYPES, csv_file_keywords, csv_file_summary

DATA = "table_name string, row long, cells map<string,string>, bucket int"
#: Folders that the tables of a store are dealt into.
BUCKETS = 64


def stable_id(*parts: Column | str) -> Column:
    """An id that the same parts give in every run."""
    return F.md5(F.concat_ws("\x1f", *parts).cast("binary"))


def _shaped(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema``, null where ``df`` lacks them."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
    ])


def sheet_rows(sheets: DataFrame, file_id: Column, keys: list[str], domain: str | None = None, level: str | None = None) -> DataFrame:
    """Rows of the sheets catalogue from what ``ingest`` describes."""
    found = sheets.withColumns({
        "file_id": file_id, "sheet_id": stable_id(file_id, *[F.col(k).cast("string") for k in keys], F.col("table_no").cast("string")),
        "sheet_name": F.col("sheet_title"), "data_domain": F.lit(domain), "sensitivity_level": F.lit(level),
    })
    return _shaped(found, SHEETS)


def file_rows(files: DataFrame, sheet_rows: DataFrame) -> DataFrame:
    """Rows of the files catalogue: ``files`` (file_id, file_name, file_type, version, file_hash, uploaded_at) and their sheets."""
    counted = sheet_rows.groupBy("file_id").agg(
        F.count(F.lit(1)).cast("int").alias("num_sheets"), F.array_sort(F.collect_list("sheet_name")).alias("_names")
    )
    met = files.join(counted, "file_id", "left")
    names = F.coalesce("_names", F.array().cast("array<string>"))
    return _shaped(met.withColumns({
        "num_sheets": F.coalesce("num_sheets", F.lit(0)), "summary": csv_file_summary(F.col("file_name"), names),
        "keywords": csv_file_keywords(F.col("file_type"), F.col("file_name")),
    }), FILES)


def data_rows(inside: DataFrame, columns: DataFrame, sheets: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(table_name, row, cells) of all tables of a batch; ``inside`` is what ``table_cells`` gives, rows count from 0."""
    on = [*keys, "table_no"]
    named = columns.select(*on, "col", "name").join(sheets.select(*on, "table_name"), on)
    data = inside.where("row > r0").select(*on, "col", (F.col("row") - F.col("r0") - 1).alias("row"), value)
    return data.join(named, [*on, "col"]).groupBy("table_name", "row").agg(
        F.map_from_entries(F.collect_list(F.struct("name", value))).alias("cells")
    )


def _bucket(table_name: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(table_name), F.lit(buckets)).cast("int")


def write_data(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """All tables in one job, appended to the store.

    Adaptive execution sizes the parts: small buckets share a task and large ones, which may hold one large table, are
    split, so a batch adds some files per bucket and never one per table.
    """
    placed = rows.select("table_name", "row", "cells", _bucket(F.col("table_name"), buckets).alias("bucket"))
    sorted_rows = placed.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "table_name", "row")
    sorted_rows.write.mode("append").partitionBy("bucket").parquet(path)


def read_rows(spark: SparkSession, path: str, table_name: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(table_name, row, cells) of one table, or of all; ``buckets`` as the store was written."""
    rows = spark.read.schema(DATA).parquet(path)
    if table_name is not None:
        rows = rows.where((F.col("bucket") == _bucket(F.lit(table_name), buckets)) & (F.col("table_name") == table_name))
    return rows.drop("bucket")


def read_data(spark: SparkSession, path: str, table_name: str, columns: list[tuple[str, str]], buckets: int = BUCKETS) -> DataFrame:
    """One table as typed columns from (name, type) pairs of the catalogue."""
    rows = read_rows(spark, path, table_name, buckets)
    return rows.select(*[F.try_element_at("cells", F.lit(n)).try_cast(SPARK_TYPES[t]).alias(n) for n, t in columns])


def page_chunks(pages: DataFrame, pages_col: str, file_id: str, size: int = 1000, overlap: int = 100) -> DataFrame:
    """Chunk rows of paged files; ``chunk_index`` counts from 0 on each page."""
    texts = pages_to_rows(pages, pages_col, [file_id]).withColumn("page_text", strip_nul(F.col("page_text")))
    found = chunk_rows(texts, fixed_chunks(F.col("page_text"), size, overlap), [file_id, "page_number"])
    found = found.withColumn("file_id", F.col(file_id).cast("string"))
    numbers = [F.col(c).cast("string") for c in ("page_number", "chunk_index")]
    return _shaped(found.withColumns({"kind": F.lit("pdf"), "chunk_id": stable_id("file_id", *numbers)}), CHUNKS)


def text_chunks(texts: DataFrame, text: str, file_id: str, kind: str = "text", size: int = 1000, overlap: int = 100) -> DataFrame:
    """Chunk rows of text and document files, with the entities of each chunk."""
    found = chunk_rows(texts, fixed_chunks(F.col(text), size, overlap), [file_id]).withColumn("file_id", F.col(file_id).cast("string"))
    return _shaped(found.withColumns({
        "kind": F.lit(kind), "entities": entities(F.col("chunk_text")), "chunk_id": stable_id("file_id", F.col("chunk_index").cast("string")),
    }), CHUNKS)
