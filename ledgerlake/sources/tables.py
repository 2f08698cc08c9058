"""Named tables: Parquet behind the session catalogue, or a database through JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.clean import nan_to_null


def read_table(spark: SparkSession, name: str, columns: list[str]) -> DataFrame:
    """Chosen columns of a table; only these are read."""
    return spark.table(name).select(*columns)


def read_jdbc(
    spark: SparkSession, url: str, table: str, columns: list[str], partition_column: str,
    lower: str, upper: str, partitions: int, **options,
) -> DataFrame:
    """The same over JDBC, read in ``partitions`` ranges of ``partition_column``."""
    return (
        spark.read.format("jdbc").options(
            url=url, dbtable=table, partitionColumn=partition_column, lowerBound=lower, upperBound=upper,
            numPartitions=partitions, **options,
        ).load().select(*columns)
    )


def append_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """Create the table if absent and append; NaN is stored as null."""
    writer = nan_to_null(df).write.mode("append").format("parquet")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def append_chunks(chunks: DataFrame, path: str) -> None:
    """Append chunk rows; adaptive execution sizes the files."""
    chunks.write.mode("append").parquet(path)
