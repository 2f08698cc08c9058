"""Structured Streaming jobs: text to chunks with entities, and file versions."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import chunk_rows, entities, fixed_chunks, paragraph_chunk_rows

VERSIONS = T.StructType([
    T.StructField("file_name", T.StringType()),
    T.StructField("arrival", T.LongType()),
    T.StructField("file_hash", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("version", T.LongType()),
])
#: What is kept of a name: its latest version and content.
_LATEST = "version long, file_hash string"

# Executors get the kernel below with the task and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def text_to_chunks(rows: DataFrame, text: str = "text", key: str = "file_id", by_paragraph: bool = True) -> DataFrame:
    """Chunk rows with entities; the same plan serves a batch and a stream."""
    chunks = paragraph_chunk_rows(rows, text, [key]) if by_paragraph else chunk_rows(rows, fixed_chunks(F.col(text)), [key])
    return chunks.withColumn("entities", entities(F.col("chunk_text")))


def start_chunk_stream(
    rows: DataFrame, target: str, checkpoint: str, text: str = "text", key: str = "file_id",
    by_paragraph: bool = True,
) -> StreamingQuery:
    """Append the chunks of all new rows to Parquet and stop when the input is used up."""
    return (
        text_to_chunks(rows, text, key, by_paragraph)
        .writeStream.format("parquet").outputMode("append")
        .option("path", target).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_versions(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.schema(VERSIONS).parquet(log)


def _versioned(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Status and version of a name's arrivals in a micro-batch, by the rule of ``assign_versions``."""
    rows = pd.concat(list(batches)).sort_values("arrival", kind="stable")
    version, latest = state.get if state.exists else (0, None)
    content = rows["file_hash"].astype(object).where(rows["file_hash"].notna(), None)
    before = content.shift()
    before.iloc[0] = latest
    before = before.where(before.notna(), None)
    new = ~((content == before) | (content.isna() & before.isna()))
    versions = version + new.cumsum()
    state.update((int(versions.iloc[-1]), content.iloc[-1]))
    yield pd.DataFrame({
        "file_name": key[0], "arrival": rows["arrival"], "file_hash": content,
        "status": np.where(new, "NEW", "DUPLICATE"), "version": versions.astype("int64"),
    })


def start_version_stream(arrivals: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Version the arrivals (file_name, arrival, file_hash) of each micro-batch into ``log`` and stop when the input is used up.

    The latest version of each name is keyed state in the checkpoint. A batch reads and writes the state of its own names only, so its cost
    follows the batch and neither the log nor the names seen before; a batch that runs twice leaves one result. A task sorts
    the arrivals that one name has in a micro-batch, which the source's limits per trigger bound.
    """
    rows = arrivals.select("file_name", F.col("arrival").cast("long").alias("arrival"), "file_hash")
    versions = rows.groupBy("file_name").applyInPandasWithState(_versioned, VERSIONS, _LATEST, "append", GroupStateTimeout.NoTimeout)
    return (
        versions.writeStream.format("parquet").outputMode("append")
        .option("path", log).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
