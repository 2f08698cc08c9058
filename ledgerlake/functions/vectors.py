"""Vectors in ``array<float>`` columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity, null for a null or zero vector."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.lit(1.0) - F.try_divide(dot(a, b), F.nullif(size, F.lit(0.0)))


def distance_to(vector: Column, query: list[float]) -> Column:
    """Cosine distance to one given vector; null for a null or zero vector, one of another length, or a zero query.

    A batch is scored at once. Sums run along each row, so equal vectors get equal distances wherever they lie.
    """
    q = np.array(query, np.float64)
    norm = float(np.sqrt((q * q).sum()))

    @F.pandas_udf("double")
    def score(vectors: pd.Series) -> pd.Series:
        out = np.full(len(vectors), np.nan)
        fit = np.array([v is not None and len(v) == len(q) for v in vectors], bool)
        if norm and fit.any():
            rows = np.stack(vectors[fit].to_list()).astype(np.float64)
            size = np.sqrt((rows * rows).sum(axis=1)) * norm
            with np.errstate(invalid="ignore", divide="ignore"):
                out[fit] = np.where(size > 0, 1.0 - (rows * q).sum(axis=1) / size, np.nan)
        return pd.Series(out)

    return F.nullif(score(vector), F.lit(float("nan")))


def confidence(distance: Column) -> Column:
    """1 - distance as text with two decimals."""
    return F.format_string("%.2f", F.lit(1.0) - distance)


def wrong_dims(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """Lengths other than ``dim`` and the number of rows with them."""
    size = F.size(vector)
    return (
        df.where(F.col(vector).isNotNull() & (size != dim))
        .groupBy(size.cast("bigint").alias("dim")).agg(F.count(F.lit(1)).alias("n_rows"))
    )


def embed_text(df: DataFrame, text: str, dim: int = 3072, out: str = "embedding") -> DataFrame:
    """TF-IDF vectors of length one; blank text gives null and every input row stays."""
    blank = F.coalesce(F.trim(text) == "", F.lit(True))
    words = df.withColumn("_t", F.coalesce(text, F.lit("")))
    model = Pipeline(stages=[
        Tokenizer(inputCol="_t", outputCol="_w"),
        HashingTF(inputCol="_w", outputCol="_tf", numFeatures=dim),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_v"),
    ]).fit(words)
    return (
        model.transform(words)
        .withColumn(out, F.when(~blank, vector_to_array("_v", "float32")))
        .drop("_t", "_w", "_tf", "_idf", "_v")
    )
