"""Exact search for the largest inner products by the threshold algorithm (Fagin, Lotem and Naor, 2001).

Vectors lie in blocks by falling norm and queries in blocks too; each pair of blocks is one unit of work, whose size does not grow with the
tables. All queries meet the first block, of the largest norms. The kth score they find there is a floor that goes with them: of each other
block only its largest and smallest component per dimension is looked at first, and a block in which no query of a query block can reach its floor is
never read by them. In a unit every dimension has a list of the vectors sorted by their component. All lists are read downwards together, from
the end that suits the sign of the query's component; each vector met is scored in full, for all queries that are still open at
once. No unseen vector can score more than the query's product with the components at the current depth, so a query is closed
as soon as that is below its floor or its kth result. The units' results are merged by query.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import Ordered
from ..session import cut

BLOCK, QUERY_BLOCK, FIRST_DEPTH = 4096, 1024, 4
#: Blocks whose extremes are held at a time.
SUMMARY_BLOCK = 4096
#: Quantised components from here on do not fit 64 bits and are an error.
MOST = 1 << 63

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def quantised(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component as long; null for a vector that is null or has null or non-finite components.

    A component that does not fit 64 bits is an error.
    """
    wide = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(wide, lambda x: x * F.lit(float(scale)))
    too_wide = F.raise_error(F.lit("a quantised component does not fit 64 bits"))
    return F.when(sound, F.transform(whole, lambda x: F.when(F.abs(x) < F.lit(float(MOST)), F.floor(x).cast("long")).otherwise(too_wide)))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    flat, ends = np.asarray(lists.flatten(), np.int64), np.asarray(lists.offsets, np.int64)
    sizes, out = np.diff(ends), np.zeros((len(lists), width), np.int64)
    rows = np.repeat(np.arange(len(lists)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products; by floating point where its whole numbers are wide enough, by Python's where 64 bits may not be."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if bound < 1 << 53:
        kind = np.float32 if bound < 1 << 24 else np.float64
        return (q.astype(kind) @ x.astype(kind).T).astype(np.int64)
    if bound < 1 << 62:
        return q @ x.T
    return q.astype(object) @ x.astype(object).T


def _narrow(scores: np.ndarray) -> np.ndarray:
    """The scores as 64-bit integers; one that does not fit is an error."""
    try:
        return scores.astype(np.int64)
    except OverflowError as e:
        raise OverflowError("a score does not fit 64 bits") from e


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Per row the columns of the k highest scores, ties to the smaller id; ``ids`` has a row for each row of scores."""
    if scores.shape[1] <= k:
        return np.tile(np.arange(scores.shape[1]), (len(scores), 1))
    kth = np.partition(scores, -k, axis=1)[:, -k][:, None]
    out = np.empty((len(scores), k), np.int64)
    order = np.argsort(-scores, axis=1, kind="stable") if scores.shape[1] <= 4 * k else None
    for r in range(len(scores)):
        over = np.flatnonzero(scores[r] > kth[r]) if order is None else order[r][scores[r][order[r]] > kth[r]]
        even = np.flatnonzero(scores[r] == kth[r])
        if len(over) + len(even) > k:
            even = even[np.argsort(ids[r, even], kind="stable")]
        out[r] = np.concatenate([over, even])[:k]
    return out


def threshold_search(
    q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, first_depth: int = FIRST_DEPTH, floors: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query row, id, score) of each query's best k among ``x`` apart from its own id, and how many vectors were scored.

    A query with a floor wants only what reaches it; what comes back may hold more.
    """
    n, lists = len(x), np.argsort(x, axis=0, kind="stable")
    seen, open_rows = np.zeros(n, bool), np.arange(len(q))
    scores, found = np.empty((len(q), 0), np.int64), np.empty((len(q), 0), np.int64)
    none = np.iinfo(np.int64).min
    floors = np.full(len(q), none) if floors is None else floors
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    depth, scored = 0, 0

    def close(rows: np.ndarray, at: np.ndarray) -> None:
        real = scores[at] != none
        done.append((np.repeat(rows, real.sum(axis=1)), found[at][real], scores[at][real]))

    while len(open_rows):
        low, depth = depth, min(n, max(first_depth, 2 * depth))
        new = np.unique(np.concatenate([lists[low:depth].ravel(), lists[n - depth : n - low].ravel()]))
        new = new[~seen[new]]
        seen[new] = True
        scored += len(new) * len(open_rows)
        more = _products(q[open_rows], x[new])
        more[q_ids[open_rows][:, None] == ids[new][None, :]] = none
        more = _narrow(more)
        scores, found = np.hstack([scores, more]), np.hstack([found, np.broadcast_to(ids[new], more.shape)])
        best = _best(scores, found, k)
        scores, found = np.take_along_axis(scores, best, 1), np.take_along_axis(found, best, 1)
        if depth == n or seen.all():
            close(open_rows, np.arange(len(open_rows)))
            break
        top, bottom = x[lists[n - depth], np.arange(x.shape[1])], x[lists[depth - 1], np.arange(x.shape[1])]
        own = q[open_rows]
        bound = _products(np.maximum(own, 0), top[None, :])[:, 0] + _products(np.minimum(own, 0), bottom[None, :])[:, 0]
        # Equal is not enough: an unseen vector of the same score may have a smaller id.
        full = bound < floors[open_rows]
        if scores.shape[1] == k:
            full |= scores.min(axis=1, initial=np.iinfo(np.int64).max) > bound
        full = full.astype(bool)
        close(open_rows[full], np.flatnonzero(full))
        open_rows, scores, found = open_rows[~full], scores[~full], found[~full]
    rows, names, values = (np.concatenate(c) if done else np.empty(0, np.int64) for c in (zip(*done) if done else ([], [], [])))
    return rows, names, values, scored


def top_k(
    vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: float = 64.0, block: int = BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest integer inner product for each row where ``queries`` is true.

    Components are floor(scale * x). A query meets all rows but those of its own id; fewer than k come back if there are no more. Ties go to the
    smaller id. Rows without an id, and vectors that are null or hold null or non-finite components, take no part. Rows that
    repeat id and vector count once. A shorter vector goes on with zeros. A component, or a score that is looked at, that does not fit 64 bits is an error.
    Other columns are not read. An empty table, or one without queries, gives an empty result.
    """
    rows = vectors.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query")
    )
    rows = cut(rows.where("v is not null").distinct())
    n, n_queries, width = rows.agg(F.count(F.lit(1)), F.count_if("is_query"), F.max(F.size("v"))).first()
    blocks, query_blocks = (max(1, math.ceil(c / size)) for c, size in zip((n, n_queries), (block, query_block), strict=True))
    width = width or 0

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    ordered = Ordered(rows.select("vec_id", "v", (-norm).alias("small")), [], [F.col("small"), F.col("vec_id")], blocked=True).number("n").done()
    placed = cut(ordered.select("vec_id", "v", F.expr(f"cast((n - 1) div {block} as long)").alias("b")))
    first = 0
    query_part = F.pmod(F.xxhash64(F.xxhash64("vec_id")), F.lit(query_blocks)).cast("int")
    asked = rows.where("is_query").select("vec_id", "v", query_part.alias("qb"))
    names = ["query_id", "vec_id", "score"]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64())] * 3, names=names)
        ids, q_ids = (np.asarray(t.column("vec_id"), np.int64) for t in (a, b))
        floors = np.asarray(b.column("floor").combine_chunks(), np.int64)
        at, found, scores, _ = threshold_search(q_ids, _matrix(b.column("v"), width), ids, _matrix(a.column("v"), width), k, floors=floors)
        high = scores >= floors[at]
        return pa.Table.from_arrays([pa.array(q_ids[at[high]]), pa.array(found[high]), pa.array(scores[high])], names=names)

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.groupBy("b", "qb").cogroup(right.groupBy("b", "qb")).applyInArrow(run, "query_id long, vec_id long, score long")

    none = F.lit(np.iinfo(np.int64).min).cast("long")
    opening = placed.where(F.col("b") == first).withColumn("qb", each(query_blocks))
    begun = cut(_first(met(opening, asked.withColumns({"b": F.lit(first).cast("long"), "floor": none})), k))
    if blocks == 1:
        return begun
    floors = begun.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    asked = cut(asked.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", none)))

    def extremes(a: pa.Table) -> pa.Table:
        x = _matrix(a.column("v"), width)
        return pa.Table.from_arrays([a.column("b").slice(0, 1), *[pa.array([f(x, axis=0)]) for f in (np.max, np.min)]], names=["b", "high", "low"])

    def reached(a: pa.Table, b: pa.Table) -> pa.Table:
        """The blocks in which some query may reach its floor."""
        if not a.num_rows or not b.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int32())], names=["b", "qb"])
        high, low, q = _matrix(a.column("high"), width), _matrix(a.column("low"), width), _matrix(b.column("v"), width)
        bound = _products(np.maximum(q, 0), high) + _products(np.minimum(q, 0), low)
        need = (bound >= np.asarray(b.column("floor").combine_chunks(), np.int64)[:, None]).any(axis=0).astype(bool)
        found = a.column("b").combine_chunks().filter(pa.array(need))
        return pa.Table.from_arrays([found, pa.array([b.column("qb")[0].as_py()] * len(found), pa.int32())], names=["b", "qb"])

    rest = placed.where(F.col("b") != first)
    summaries = rest.groupBy("b").applyInArrow(extremes, "b long, high array<long>, low array<long>")
    held = max(1, math.ceil(blocks / SUMMARY_BLOCK))
    chunk = F.pmod(F.xxhash64("b"), F.lit(held)).cast("int")
    left = summaries.withColumn("chunk", chunk).withColumn("qb", each(query_blocks))
    right = asked.withColumn("chunk", each(held))
    pairs = cut(left.groupBy("chunk", "qb").cogroup(right.groupBy("chunk", "qb")).applyInArrow(reached, "b long, qb int"))
    more = met(rest.join(pairs, "b"), asked.join(pairs, "qb"))
    return _first(begun.drop("rank").unionByName(more), k)


def _first(met: DataFrame, k: int) -> DataFrame:
    ranked = met.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
