"""Exact nearest neighbours of many vectors over stored clusters: the triangle inequality says which clusters and rows cannot matter.

Vectors of length one lie in clusters around centres, each row with its gap, the distance to its centre. A row is no nearer to a
request than the difference between its gap and the request's distance to the centre. So the clusters next to a request give a first
``k`` rows, and of all others only those rows are scored that this bound lets be nearer than the last of them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.vectors import dot
from ..session import cut

#: Requests that are answered by one scan.
QUERY_BLOCK = 1024
# What rounding may add to a squared distance and to a distance.
_SLACK = 1e-9

# Executors get the kernels with the task and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _fit(vector: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` finite components, not all of them 0."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & finite & (dot(vector, vector) > 0), F.lit(False))


def _matrix(vectors: pd.Series) -> np.ndarray:
    """The rows as vectors of length one."""
    rows = np.stack(vectors.to_numpy()).astype(np.float64)
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def _distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    squares = (rows * rows).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None] - 2 * rows @ points.T
    return np.sqrt(np.maximum(squares, 0))


def build(
    corpus: DataFrame, vector: str, id_col: str, path: str, dim: int, clusters: int = 64, fit_rows: int = 20_000, seed: int = 1
) -> ClusteredVectors:
    """Write the vectors of ``corpus`` in clusters under ``path``.

    Only the centres are fitted on a bounded sample, the ``fit_rows`` rows with the least hash of their id; every row is stored in
    its cluster, and results do not depend on where the centres are. Vectors that are null, zero, not finite or not of length ``dim``
    have no distance and are left out. A cluster of any size is written by as many tasks as its bytes need.
    """
    spark = corpus.sparkSession
    rows = corpus.where(_fit(F.col(vector), dim)).select(F.col(id_col).alias("id"), F.col(vector).alias("vector"))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(fit_rows).select(
        array_to_vector(F.transform("vector", lambda x: x.cast("double") / F.sqrt(dot(F.col("vector"), F.col("vector"))))).alias("features"))
    sample = cut(sample)
    centres = np.zeros((1, dim))
    if not sample.isEmpty():
        centres = np.array(KMeans(k=max(clusters, 2), seed=seed, maxIter=10).fit(sample).clusterCenters())

    @F.pandas_udf("struct<cluster: int, gap: double>")
    def placed(vectors: pd.Series) -> pd.DataFrame:
        unit = _matrix(vectors)
        nearest = _distances(unit, centres).argmin(axis=1)
        away = unit - centres[nearest]
        return pd.DataFrame({"cluster": nearest.astype(np.int32), "gap": np.sqrt((away * away).sum(axis=1))})

    stored = rows.withColumn("place", placed("vector")).select("id", "vector", "place.gap", "place.cluster")
    sorted_rows = stored.hint("rebalance", F.col("cluster")).sortWithinPartitions("cluster", "gap", "id")
    sorted_rows.write.mode("errorifexists").partitionBy("cluster").parquet(f"{path}/rows")
    schema = T.StructType([*rows.schema.fields, T.StructField("gap", T.DoubleType()), T.StructField("cluster", T.IntegerType())])
    made = ClusteredVectors(spark, path, schema, id_col)
    spread = made.rows().groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.min("gap").alias("least"), F.max("gap").alias("most"))
    listed = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cluster int, centre array<double>")
    listed.join(spread, "cluster").coalesce(1).write.mode("errorifexists").parquet(f"{path}/centres")
    return made


@dataclass
class _Plan:
    """Requests against clusters: which pairs to score, and how near a row must be."""

    names: list[str]
    unit: np.ndarray
    at: dict[int, int]
    away: np.ndarray
    wanted: np.ndarray
    reach: np.ndarray

    def rows(self, stored: DataFrame) -> DataFrame:
        """The stored rows that some request needs: folders by cluster, row groups by gap."""
        needed = {c: i for c, i in self.at.items() if self.wanted[:, i].any()}
        near = []
        for c, i in needed.items():
            of = self.wanted[:, i]
            low, high = (self.away[of, i] - self.reach[of]).min(), (self.away[of, i] + self.reach[of]).max()
            inside = F.col("cluster") == c
            near.append(inside & F.col("gap").between(float(low), float(high)) if np.isfinite(high) else inside)
        if not near:
            return stored.where("false")
        return stored.where(F.col("cluster").isin(list(needed)) & reduce(lambda a, b: a | b, near))

    def pairs(self, cluster: np.ndarray, gap: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each request with the rows of a batch that it has to score."""
        place = np.array([self.at[c] for c in cluster.tolist()], np.int64)
        for j in range(len(self.names)):
            need = np.flatnonzero(self.wanted[j, place] & (np.abs(self.away[j, place] - gap) <= self.reach[j]))
            if len(need):
                yield j, need


def _scorer(plan: _Plan, k: int):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            rows, ids = _matrix(pdf["vector"]), pdf["id"].to_numpy()
            for j, need in plan.pairs(pdf["cluster"].to_numpy(), pdf["gap"].to_numpy()):
                near = rows[need]
                # Sums along each row, so equal vectors get equal distances in any batch.
                distance = 1.0 - (near * plan.unit[j]).sum(axis=1)
                if len(distance) > k:
                    some = np.flatnonzero(distance <= np.partition(distance, k - 1)[k - 1])
                    some = some[np.lexsort((ids[need[some]], distance[some]))[:k]]
                else:
                    some = np.arange(len(distance))
                yield pd.DataFrame({"query_id": plan.names[j], "id": ids[need[some]], "distance": distance[some]})

    return score


def _counter(plan: _Plan):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = plan.pairs(pdf["cluster"].to_numpy(), pdf["gap"].to_numpy())
            yield pd.DataFrame({"n": [sum(len(need) for _, need in found)]}, dtype="int64")

    return count


@dataclass(frozen=True)
class ClusteredVectors:
    """Vectors stored by ``build``, as rows of ``schema``."""

    spark: SparkSession
    path: str
    schema: T.StructType
    id_col: str = "id"

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def _centres(self) -> list:
        """One row per filled cluster; their number is a parameter of the index."""
        return self.spark.read.parquet(f"{self.path}/centres").orderBy("cluster").collect()

    def _best(self, scored: DataFrame, k: int) -> DataFrame:
        ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")))
        return ranked.where(F.col("rank") <= k)

    def _run(self, plan: _Plan, k: int) -> DataFrame:
        kind = self.schema["id"].dataType
        schema = T.StructType([T.StructField("query_id", T.StringType()), T.StructField("id", kind), T.StructField("distance", T.DoubleType())])
        return plan.rows(self.rows()).select("id", "vector", "cluster", "gap").mapInPandas(_scorer(plan, k), schema)

    def _plans(self, queries: dict[str, list[float]], k: int) -> Iterator[tuple[_Plan, _Plan, DataFrame]]:
        """Per block of requests: the nearest clusters, the rest within reach of what they gave, and the best of the first."""
        centres = self._centres()
        names = [n for n, q in queries.items() if any(q)]
        if not centres or not names or k < 1:
            return
        points = np.array([c.centre for c in centres])
        n, least, most = (np.array([c[f] for c in centres], np.float64) for f in ("n", "least", "most"))
        at = {c.cluster: i for i, c in enumerate(centres)}
        for start in range(0, len(names), QUERY_BLOCK):
            block = names[start:start + QUERY_BLOCK]
            unit = _matrix(pd.Series([np.array(queries[b], np.float64) for b in block]))
            away = _distances(unit, points)
            bound = np.maximum(np.maximum(away - most, least - away), 0)
            # The nearest clusters that hold k rows together; those before the one that completes them are taken whole.
            order = np.argsort(away, axis=1, kind="stable")
            before = np.cumsum(n[order], axis=1) - n[order]
            first = np.zeros(away.shape, bool)
            np.put_along_axis(first, order, before < k, axis=1)
            near = _Plan(block, unit, at, away, first, np.full(len(block), np.inf))
            best = cut(self._best(self._run(near, k), k))
            last = dict(best.where(F.col("rank") == k).select("query_id", "distance").collect())
            reach = np.array([np.sqrt(2 * max(last[b] + _SLACK, 0)) + _SLACK if b in last else np.inf for b in block])
            yield near, _Plan(block, unit, at, away, ~first & (bound <= reach[:, None]), reach), best

    def nearest(self, queries: dict[str, list[float]], k: int) -> DataFrame:
        """The ``k`` nearest rows of each request: ``query_id, id, distance, rank``, ties by id. Zero requests have none.

        The requests and the distance of each one's k-th row so far are all that the driver holds.
        """
        found = [best.drop("rank").unionByName(self._run(rest, k)) for _, rest, best in self._plans(queries, k)]
        if not found:
            kind = self.schema["id"].dataType.simpleString()
            return self.spark.createDataFrame([], f"query_id string, {self.id_col} {kind}, distance double, rank int")
        return self._best(reduce(DataFrame.unionByName, found), k).withColumnRenamed("id", self.id_col)

    def share_scored(self, queries: dict[str, list[float]], k: int) -> float:
        """The share of all pairs of a request and a row whose distance ``nearest`` computes; no vector is read for the count."""
        total = self.rows().count() * sum(1 for q in queries.values() if any(q))
        scored = 0
        for near, rest, _ in self._plans(queries, k):
            for plan in (near, rest):
                part = plan.rows(self.rows()).select("cluster", "gap").mapInPandas(_counter(plan), "n long")
                scored += part.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return scored / total if total else 0.0
