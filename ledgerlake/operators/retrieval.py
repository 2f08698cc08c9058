"""Nearest-neighbour and hybrid search, and the choice of an answer."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import strip
from ..functions.vectors import confidence, distance_to
from .policy import visible_sheets

# Openings of a question about where data is kept.
METADATA_OPENINGS = ("which file", "what file", "which sheet", "what sheet", "where is", "source of")

QUERY_BLOCK = 1024

# Executors get the scoring kernel with the task and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def nearest(df: DataFrame, vector: str, query: list[float], k: int, tie: list[str]) -> DataFrame:
    """The ``k`` rows nearest to one vector; each task keeps ``k`` rows, nothing is sorted whole."""
    return (
        df.withColumn("distance", distance_to(F.col(vector), query))
        .orderBy(F.col("distance").asc_nulls_last(), *tie).limit(k)
    )


def nearest_many(corpus: DataFrame, vector: str, id_col: str, queries: dict[str, list[float]], k: int) -> DataFrame:
    """The ``k`` nearest rows for each of several vectors: ``query_id, id, distance, rank``.

    A batch of rows is scored against a block of vectors as one matrix product and
    reduced at once to its best ``k`` per vector, so what is shuffled is bounded by
    batches x vectors x k and no pair table exists. Beyond ``QUERY_BLOCK`` vectors the
    corpus is scanned once per block. Zero and null vectors have no distance and
    take no part.
    """
    ids = [n for n, q in queries.items() if any(q)]
    id_type = corpus.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("query_id", T.StringType()), T.StructField(id_col, id_type),
        T.StructField("distance", T.DoubleType()),
    ])
    pruned = corpus.where(F.col(vector).isNotNull()).select(id_col, vector)
    best = None
    for start in range(0, len(ids), QUERY_BLOCK):
        names = ids[start:start + QUERY_BLOCK]
        matrix = np.array([queries[n] for n in names], dtype=np.float64)
        part = pruned.mapInPandas(_block_scorer(names, matrix, vector, id_col, k), schema)
        best = part if best is None else best.unionByName(part)
    if best is None:
        return corpus.sparkSession.createDataFrame([], schema.add("rank", T.IntegerType()))
    w = Window.partitionBy("query_id").orderBy("distance", id_col)
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _block_scorer(names: list[str], matrix: np.ndarray, vector: str, id_col: str, k: int):
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            rows = np.stack(pdf[vector].to_numpy()).astype(np.float64)
            norm = np.linalg.norm(rows, axis=1)
            fine = norm > 0
            ids = pdf[id_col].to_numpy()[fine]
            dist = 1.0 - (rows[fine] / norm[fine, None]) @ unit.T
            out = []
            for j, name in enumerate(names):
                d = dist[:, j]
                if len(d) > k:
                    # Keep every row as near as the k-th, so ties are settled by id later.
                    near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                    near = near[np.lexsort((ids[near], d[near]))[:k]]
                else:
                    near = np.arange(len(d))
                out.append(pd.DataFrame({"query_id": name, id_col: ids[near], "distance": d[near]}))
            yield pd.concat(out)

    return score


def contains_text(column: Column, text: str) -> Column:
    """Case-insensitive containment of literal text."""
    return F.contains(F.lower(column), F.lit(text.lower()))


def hybrid_search(
    sheets: DataFrame, files: DataFrame, policies: DataFrame, role: str, question: str,
    query: list[float], k: int = 3,
) -> DataFrame:
    """Visible sheets ranked by file-name match, then distance; the best ``k``.

    Distances are taken where the sheets are read, so no vector is shuffled.
    """
    near = visible_sheets(sheets, policies, role).withColumn(
        "distance", distance_to(F.col("summary_embedding"), query)
    ).drop("summary_embedding")
    named = near.join(files.select("file_id", "file_name"), "file_id")
    return (
        named.withColumn("name_rank", F.when(contains_text(F.col("file_name"), question), 0).otherwise(1))
        .orderBy("name_rank", F.col("distance").asc_nulls_last(), "sheet_id").limit(k)
    )


def semantic_search(
    sheets: DataFrame, files: DataFrame, query: list[float], threshold: float = 0.7, limit: int = 10,
    policies: DataFrame | None = None, role: str | None = None,
) -> DataFrame:
    """Sheets more similar than ``threshold``, most similar first; policies apply only when a role is given."""
    if role is not None:
        sheets = visible_sheets(sheets, policies, role)
    similar = sheets.withColumn("similarity", F.lit(1.0) - distance_to(F.col("summary_embedding"), query))
    # No vector goes through the join.
    return (
        similar.drop("summary_embedding").where(F.col("similarity") > threshold)
        .join(files.select("file_id", "file_name"), "file_id")
        .orderBy(F.col("similarity").desc(), "sheet_id").limit(limit)
    )


def is_metadata_question(question: Column) -> Column:
    return F.lower(strip(question)).rlike(f"^({'|'.join(METADATA_OPENINGS)})")


def metadata_answer(
    sheets: DataFrame, files: DataFrame, policies: DataFrame, role: str, question: str, query: list[float]
) -> DataFrame:
    """File, sheet, table, category and confidence of the best sheet."""
    return hybrid_search(sheets, files, policies, role, question, query, 1).select(
        "file_name", "sheet_name", "table_name", "category", confidence(F.col("distance")).alias("confidence")
    )


def candidate_quality(candidates: DataFrame, cells: DataFrame, keys: list[str], rank: str, value: str) -> DataFrame:
    """``meaningful`` for each candidate result, given the result cells in long form.

    Empty results are not; a single cell must be neither null, NaN nor 0; anything larger is.
    """
    on = [*keys, rank]
    kind = cells.schema[value].dataType
    zero = F.lit("0") if isinstance(kind, T.StringType) else F.lit(0)
    filled = F.col(value) != zero
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        filled &= ~F.isnan(value)
    shape = cells.groupBy(*on).agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(filled).alias("_filled"))
    n = F.coalesce("n_cells", F.lit(0))
    return (
        candidates.join(shape, on, "left")
        .withColumn("meaningful", (n > 1) | ((n == 1) & (F.col("_filled") == 1)))
        .withColumn("n_cells", n).drop("_filled")
    )


def best_candidate(quality: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """Per question the first meaningful candidate by rank, else the first."""
    best = F.min(F.struct((~F.col("meaningful")).alias("empty"), F.col(rank).alias("rank")))
    return quality.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, F.col("_b.rank").alias("best_rank"), (~F.col("_b.empty")).alias("meaningful")
    )
