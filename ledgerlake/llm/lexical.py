"""Ranked lexical search with bags of words scored once.

Of a document only the words of the queries matter: its bag, the counts of these words, and its length norm m. Documents of one bag and m are
one class, met by a 128-bit hash and verified by their bytes. Each class is scored once against all queries and stands for its members in ascending
order of ids, of which no query needs more than it asks for.

Scoring is a BM25 in integers: a term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))), a document scores the sum of
w * (10^9 tf div (1000 tf + 8 m)) over a query's distinct terms, with m = 10 + (90 n N) div L.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from . import words as words_module
from .exact_dedup import content_hash
from .words import Words, folded, slices

#: (query, term) rows that are held by a task at a time; more queries go in several blocks.
BLOCK_TERMS = 200_000
#: Scores of a block of classes, and sums that make them, held at a time.
_CELLS = 1 << 20

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(words_module)


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term), distinct and written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(folded(batch.column("text")), lower=False)
            rows = np.repeat(np.arange(batch.num_rows), words.sizes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").take(pa.array(rows)), words.distinct.take(pa.array(words.codes))], names=["item_id", "term"]
            )

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return cut(rows.mapInArrow(run, "item_id long, term string").distinct())


def bags(docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, bag): all terms of a document, and the counts of those in the sorted vocabulary, as pairs of 32 bits (number, count)."""
    terms = pa.array(vocabulary, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(folded(batch.column("text")), lower=False)
            number = np.asarray(pc.fill_null(pc.index_in(words.distinct, value_set=terms), -1), np.int64)[words.codes]
            found = np.flatnonzero(number >= 0)
            rows = np.repeat(np.arange(batch.num_rows), words.sizes())[found]
            keys, counts = np.unique(rows * len(terms) + number[found], return_counts=True)
            pairs = np.stack([keys % max(1, len(terms)), counts], axis=1).astype("<u4")
            ends = np.searchsorted(keys, np.arange(batch.num_rows + 1) * len(terms)) * 8
            raw = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(pairs)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words.sizes()), raw], names=["doc_id", "n", "bag"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return cut(rows.mapInArrow(run, "doc_id long, n long, bag binary"))


def _pairs(bags: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term number and count of each pair in an array of bags."""
    sizes = np.asarray(pc.binary_length(bags), np.int64) // 8
    flat = np.frombuffer(b"".join(bags.to_pylist()), "<u4").reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(bags)), sizes), flat[:, 0], flat[:, 1]


def document_counts(table: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each term; one bounded row of counts leaves a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_terms, np.int64)
        for batch in slices(batches, "bag"):
            counts += np.bincount(_pairs(batch.column("bag"))[1], minlength=n_terms)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], names=["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for row in table.select("bag").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[row.term] = row.df
    return out


def classes(table: DataFrame, documents: int, length: int, k: int) -> DataFrame:
    """(bag, m, members): each distinct bag and norm once, with its k smallest ids. Tasks send at most k rows of a class."""
    norm = F.expr(f"100 - 90 + (90 * n * {documents}L) div {max(1, length)}L")
    rows = table.where(F.octet_length("bag") > 0).select("doc_id", "bag", norm.cast("long").alias("m"))
    rows = rows.withColumn("key", content_hash(F.concat("bag", F.lit(b"/"), F.col("m").cast("string").cast("binary"))))
    # Equal hashes meet first; bag and m, which complete the key, tell apart what only shares a hash.
    same = ["key", "m", "bag"]
    nth = F.row_number().over(Window.partitionBy(*same).orderBy(F.col("doc_id").asc_nulls_last()))
    few = rows.withColumn("nth", nth).where(F.col("nth") <= k)
    members = F.transform(F.array_sort(F.collect_list(F.struct("nth", "doc_id"))), lambda r: r["doc_id"])
    return few.groupBy(*same).agg(members.alias("members")).drop("key")


class Scorer:
    """Scores of classes for a block of queries, and the best k classes of each query so far."""

    def __init__(self, weights: np.ndarray, ends: np.ndarray, items: np.ndarray, n_items: int, k: int):
        # Term t belongs to the queries items[ends[t] : ends[t + 1]].
        self.weights, self.ends, self.items, self.n_items, self.k = weights, ends, items, n_items, k
        self.item, self.score, self.first, self.row = (np.empty(0, np.int64) for _ in range(4))
        self.least = np.ones(n_items, np.int64)
        self.rows: list[list[int | None]] = []

    def _scores(self, rows: np.ndarray, term: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        counts = self.ends[term + 1] - self.ends[term]
        at = np.repeat(self.ends[term] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        cells = np.repeat(rows * self.n_items, counts) + self.items[at]
        # Sums stay below 2^53 (checked when the queries are read), so doubles add them exactly.
        return np.bincount(cells, np.repeat(value, counts), n * self.n_items).astype(np.int64).reshape(n, self.n_items)

    def add(self, bag: pa.Array, m: np.ndarray, members: pa.Array) -> None:
        rows, term, tf = _pairs(bag)
        value = self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[rows]))
        work = np.bincount(rows, self.ends[term + 1] - self.ends[term], len(bag)) + self.n_items
        block = (np.cumsum(work) // _CELLS).astype(np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(bag)]])
        at = np.searchsorted(rows, cuts)
        for low, high, a, b in zip(cuts[:-1], cuts[1:], at[:-1], at[1:], strict=True):
            scores = self._scores(rows[a:b] - low, term[a:b], value[a:b], high - low)
            row, item = np.nonzero(scores >= self.least)
            if len(row):
                self._keep(item, scores[row, item], members.take(pa.array(row + low)))

    def _keep(self, item: np.ndarray, score: np.ndarray, members: pa.Array) -> None:
        lists = members.to_pylist()
        first = np.array([np.iinfo(np.int64).max if ids[0] is None else ids[0] for ids in lists], np.int64)
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, score])
        first, lists = np.concatenate([self.first, first]), self.rows + lists
        order = np.lexsort((first, -score, item))
        ordered = item[order]
        place = np.arange(len(order)) - np.searchsorted(ordered, ordered)
        order, place = order[place < self.k], place[place < self.k]
        self.item, self.score, self.first, self.rows = item[order], score[order], first[order], [lists[i] for i in order]
        full = place == self.k - 1
        self.least[self.item[full]] = self.score[full]


def _ranked(docs: DataFrame, terms: list[tuple[int | None, str]], k: int, id_col: str, text_col: str) -> DataFrame:
    vocabulary, item_ids = sorted({t for _, t in terms}), list(dict.fromkeys(i for i, _ in terms))
    number, place = {t: i for i, t in enumerate(vocabulary)}, {item: i for i, item in enumerate(item_ids)}
    owned = np.array(sorted((number[t], place[i]) for i, t in terms), np.int64).reshape(-1, 2)
    ends = np.searchsorted(owned[:, 0], np.arange(len(vocabulary) + 1))
    table = bags(docs, vocabulary, id_col, text_col)
    whole = table.agg(F.sum(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
    documents, length = int(whole[0] or 0), int(whole[1] or 0)
    df = document_counts(table, len(vocabulary))
    weights = np.floor(1000 * np.log((2.0 * documents + 2) / (2.0 * df + 1))).astype(np.int64)
    if len(owned) and np.bincount(owned[:, 1], weights[owned[:, 0]] * 1e6).max() >= 2.0**53:
        raise ValueError("a query has too many terms for exact sums")
    n_items = len(item_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Scorer(weights, ends, owned[:, 1], n_items, k)
        for batch in slices(batches, "bag"):
            best.add(batch.column("bag"), np.asarray(batch.column("m")), batch.column("members"))
        yield pa.RecordBatch.from_arrays([
            pa.array([item_ids[i] for i in best.item], pa.int64()), pa.array(best.score), pa.array(best.rows, pa.list_(pa.int64())),
        ], names=["item_id", "score", "members"])

    found = classes(table, documents, length, k).mapInArrow(run, "item_id long, score long, members array<long>")
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.element_at("members", 1).asc_nulls_last())
    found = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k)
    each = found.select("item_id", "score", F.explode("members").alias("doc_id"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 for each item, equal scores by ascending doc_id.

    Terms are the longest runs of letters and digits of ASCII and of all signs beyond ASCII, lower-cased in A-Z. Null text has none. Items of one
    id are one item with the terms of all its rows; an item without terms, or whose terms no document holds, has no rows. Every row of
    ``docs`` counts and can be found, repeated ones too; rows without an id come after all others of their score. Other columns are not read.
    Empty tables give an empty result.
    """
    terms = query_terms(items, item_id_col, item_text_col)
    blocks = terms.count() // block_terms + 1
    parts = []
    for i in range(blocks):
        own = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i)
        parts.append(_ranked(docs, sorted(map(tuple, own.collect()), key=repr), k, id_col, text_col))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
