"""Streaming queries; each must equal its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ENTITY_KINDS
from ..session import new_path
from ..streaming import jobs
from .catalog import VERSION_CTES
from .registry import query
from .text import CHUNK_SQL, entity_sql
from .views import oracle, table


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    # A glob, as the file source takes a plain path for a folder.
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


@query("stream_chunks", f"WITH c AS ({CHUNK_SQL}) SELECT doc_id, chunk_index, chunk_text, " + ", ".join(
    f"array_to_string({sql}, '|') AS {k}" for k, sql in entity_sql("chunk_text").items()) + " FROM c")
def stream_chunks(spark: SparkSession, d: str) -> DataFrame:
    base = new_path(spark, "stream-chunks")
    docs = _stream(spark, d, "documents")
    jobs.start_chunk_stream(docs, f"{base}/out", f"{base}/state", "text", "doc_id", by_paragraph=False).awaitTermination()
    return spark.read.parquet(f"{base}/out").select(
        "doc_id", "chunk_index", "chunk_text", *[F.array_join(f"entities.{k}", "|").alias(k) for k in ENTITY_KINDS]
    )


@query("stream_versions", oracle("versions_v", body=VERSION_CTES + " SELECT * FROM versions"))
def stream_versions(spark: SparkSession, d: str) -> DataFrame:
    base = new_path(spark, "stream-versions")
    arrivals = _stream(spark, d, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file_name"), F.col("event_id").alias("arrival"),
        F.md5("event_type").alias("file_hash"),
    )
    jobs.start_version_stream(arrivals, f"{base}/log", f"{base}/state").awaitTermination()
    return jobs.read_versions(spark, f"{base}/log")
