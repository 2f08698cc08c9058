"""The catalogue: files, sheets, chunks, their versions, queries and upkeep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import Ordered

CATALOGUE_TABLES = ("files_metadata", "sheets_metadata")


# Versions -----------------------------------------------------------------

def latest_version(files: DataFrame) -> DataFrame:
    """Newest version per file name."""
    rest = [c for c in files.columns if c not in ("file_name", "version")]
    return files.groupBy("file_name").agg(
        F.max("version").alias("version"), F.max_by(F.struct(*rest), "version").alias("_r")
    ).select("file_name", "version", "_r.*")


def assign_versions(
    arrivals: DataFrame, stored: DataFrame | None = None, arrival: str = "arrival"
) -> DataFrame:
    """``status`` and ``version`` of every arrival (file_name, <arrival>, file_hash).

    An arrival equal to the latest content of its name is a DUPLICATE; any other is
    NEW and gets the next version. ``stored`` holds the latest (file_name, version,
    file_hash) known before.
    """
    o = Ordered(arrivals, ["file_name"], [F.col(arrival)]).lag("file_hash", "_prev")
    if stored is None:
        o.df = o.df.withColumns({"_v0": F.lit(0), "_h0": F.lit(None).cast("string")})
    else:
        last = stored.select("file_name", F.col("version").alias("_v"), F.col("file_hash").alias("_h0"))
        o.df = o.df.join(last, "file_name", "left").withColumn("_v0", F.coalesce("_v", F.lit(0))).drop("_v")
    o.df = o.df.withColumn("_new", (~F.col("file_hash").eqNullSafe(F.coalesce("_prev", "_h0"))).cast("int"))
    rows = o.running_sum(F.col("_new"), "_n").done()
    return rows.select(
        *arrivals.columns,
        F.when(F.col("_new") == 1, "NEW").otherwise("DUPLICATE").alias("status"),
        (F.col("_v0") + F.col("_n")).cast("bigint").alias("version"),
    )


# Queries ------------------------------------------------------------------

def list_files(files: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of files, newest first."""
    return files.orderBy(F.col("uploaded_at").desc(), "file_id").offset(offset).limit(limit)


def file_detail(files: DataFrame, sheets: DataFrame, file_id: str) -> DataFrame:
    """A file with its sheets by name, one row per sheet (one row with nulls when it has none)."""
    # The id is a key, so there is one file row to send to the sheets, however many they are.
    one = files.where(F.col("file_id") == file_id).limit(1)
    mine = sheets.where(F.col("file_id") == file_id)
    with_sheets = mine.join(F.broadcast(one), "file_id")
    if mine.isEmpty():
        return one.unionByName(with_sheets, allowMissingColumns=True)
    return with_sheets.select(*one.columns, *[c for c in mine.columns if c != "file_id"]).orderBy("sheet_name")


def sheet_by_id(sheets: DataFrame, sheet_id: str) -> DataFrame:
    return sheets.where(F.col("sheet_id") == sheet_id)


def sheets_explorer(sheets: DataFrame, files: DataFrame) -> DataFrame:
    """All sheets with their files, newest file first, then by sheet name."""
    return (
        sheets.join(files.select("file_id", "file_name", "uploaded_at"), "file_id")
        .withColumn("category", F.coalesce("category", F.lit("Uncategorized")))
        .orderBy(F.col("uploaded_at").desc(), "sheet_name")
    )


def catalog_stats(files: DataFrame, sheets: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of totals."""
    names = ["total_files", "total_sheets", "total_rows", "total_pdf_chunks"]

    def part(df: DataFrame, **values: Column) -> DataFrame:
        return df.agg(*[values.get(n, F.lit(0)).cast("bigint").alias(n) for n in names])

    n = F.count(F.lit(1))
    parts = [
        part(files, total_files=n),
        part(sheets, total_sheets=n, total_rows=F.coalesce(F.sum("num_rows"), F.lit(0))),
        part(chunks.where("kind = 'pdf'"), total_pdf_chunks=n),
    ]
    return reduce(DataFrame.unionByName, parts).agg(*[F.sum(x).alias(x) for x in names])


def preview(df: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """The first ``n`` rows, each with the number of rows beyond them."""
    more = max(df.count() - n, 0)
    return df.orderBy(*order).limit(n).withColumn("more_rows", F.lit(more).cast("bigint"))


def union_tables(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables by column name; columns a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def parse_columns_metadata(text: Column, schema: T.StructType) -> Column:
    """Column metadata from JSON text; unreadable text is an empty list."""
    parsed = F.from_json(text, T.ArrayType(schema))
    return F.coalesce(parsed, F.array().cast(T.ArrayType(schema)))


# Changes ------------------------------------------------------------------

def update_by_key(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """A new snapshot: changed columns take the new value where there is one; a key changed twice is an error."""
    twice = changes.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
    if twice is not None:
        raise ValueError(f"more than one change for {key} {twice[key]}")
    cols = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_n_{c}") for c in cols])
    return table.join(new, key, "left").select(*[
        F.coalesce(f"_n_{c}", c).alias(c) if c in cols else F.col(c) for c in table.columns
    ])


def cascade_delete(
    files: DataFrame, sheets: DataFrame, chunks: DataFrame, deleted: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Snapshots without the deleted file ids, and the names of data tables to drop."""
    ids = deleted.select("file_id").distinct()
    kept = tuple(t.join(ids, "file_id", "left_anti") for t in (files, sheets, chunks))
    return (*kept, sheets.join(ids, "file_id", "left_semi").select("table_name"))


def validate(files: DataFrame, sheets: DataFrame, chunks: DataFrame, policies: DataFrame) -> DataFrame:
    """One row: counts, rows without a file, doubled policies, unseen sheets, and whether all is well."""
    names = ["files_count", "sheets_count", "orphan_sheets", "orphan_chunks", "duplicate_policies", "unseen_sheets"]

    def part(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(
            *[(F.col("n") if x == name else F.lit(0)).cast("bigint").alias(x) for x in names]
        )

    known = files.select("file_id")
    granted = policies.where("allowed").select("data_domain", "sensitivity_level").distinct()
    labelled = sheets.where("data_domain is not null and sensitivity_level is not null")
    parts = [
        part(files, "files_count"),
        part(sheets, "sheets_count"),
        part(sheets.join(known, "file_id", "left_anti"), "orphan_sheets"),
        part(chunks.join(known, "file_id", "left_anti"), "orphan_chunks"),
        part(policies.groupBy("role", "data_domain", "sensitivity_level").count().where("count > 1"),
             "duplicate_policies"),
        part(labelled.join(granted, ["data_domain", "sensitivity_level"], "left_anti"), "unseen_sheets"),
    ]
    one = reduce(DataFrame.unionByName, parts).agg(*[F.sum(x).alias(x) for x in names])
    broken = F.col("orphan_sheets") + F.col("orphan_chunks") + F.col("duplicate_policies")
    return one.withColumn("is_healthy", broken == 0)


# Upkeep of the session catalogue ------------------------------------------

def catalogue_exists(spark: SparkSession) -> bool:
    return all(spark.catalog.tableExists(t) for t in CATALOGUE_TABLES)


def drop_tables(spark: SparkSession, names: list[str]) -> int:
    for n in names:
        spark.sql(f"DROP TABLE IF EXISTS `{n}`")
    return len(names)


def cleanup(spark: SparkSession, confirm: bool = False) -> int:
    """Drop the tables the sheets catalogue names and clear the catalogue; returns the number of dropped tables."""
    if not confirm:
        raise ValueError("cleanup drops all generated tables; pass confirm=True")
    dropped = 0
    if spark.catalog.tableExists("sheets_metadata"):
        named = spark.table("sheets_metadata").select("table_name").where("table_name is not null").distinct()
        # One name at a time comes to the driver.
        names = [r.table_name for r in named.toLocalIterator()]
        dropped = drop_tables(spark, [n for n in names if n not in CATALOGUE_TABLES and spark.catalog.tableExists(n)])
    for t in CATALOGUE_TABLES:
        if spark.catalog.tableExists(t):
            # External tables cannot be truncated.
            spark.createDataFrame([], spark.table(t).schema).write.insertInto(t, overwrite=True)
    return dropped


def optimise(spark: SparkSession, table: str) -> None:
    """Refresh the statistics the optimiser plans with."""
    spark.sql(f"ANALYZE TABLE `{table}` COMPUTE STATISTICS FOR ALL COLUMNS")


def compact(df: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """Rewrite many small files as few large ones."""
    parts = max(1, -(-df.count() // rows_per_file))
    df.repartition(parts).write.mode("errorifexists").parquet(path)
