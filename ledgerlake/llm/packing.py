"""Packing token streams into windows by deficit round robin over source queues.

Every source is a queue of tokens. A round fills one window and gives each queue its quantum, the window's size times the source's share
in all tokens. A quantum is a fraction while a queue gives whole tokens; what it was given too little or too much is its deficit, which it
carries into the next round. Each window so has the target proportions to within a token or two per source, all queues run
dry together, and only the last window is not full. As every token is packed once, no other proportions can hold in all windows.

The deficits after any number of rounds follow from the sums of tokens alone, by exact integer arithmetic: before token ``p`` of the packed stream,
the queues up to one that ends at token ``c`` of all ``total`` have given floor(p * c / total) tokens. So any task can cut any stretch of any queue by itself,
and deficits pass from partition to partition without passing through one. Sources with less than one token per window share a
queue, which bounds the queues by the tokens of a window.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import Ordered
from ..session import cut, new_path
from . import words as words_module
from .words import slices

WINDOW = 4096
#: Rows of (source, part) that are sent to all tasks, some 10 MB.
BROADCAST_ROWS = 100_000
#: The arithmetic is exact up to so many tokens.
MOST_TOKENS = 1 << 50

_CODED = pa.schema([
    ("doc_id", pa.int64()), ("source", pa.string()), ("part", pa.int32()), ("earlier", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()),
])
_CODED_SCHEMA = "doc_id long, source string, part int, earlier long, n long, ids binary"
PIECE_SCHEMA = "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(words_module)


def share(p: np.ndarray, c: np.ndarray, total: int) -> np.ndarray:
    """floor(p * c / total) for 0 <= p, c <= total <= MOST_TOKENS, exactly: a quotient in doubles is off by one at most."""
    q = np.floor(p.astype(np.float64) * (c / total)).astype(np.int64)
    for _ in range(2):
        with np.errstate(over="ignore"):
            rest = p * c - q * np.int64(total)
        q = q + (rest >= total) - (rest < 0)
    return q


def pieces_of(at: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray, total: int, window: int) -> tuple[np.ndarray, ...]:
    """The pieces of documents, in order: document number, start in it, length, window, offset in the window.

    A document has ``n`` tokens from token ``at`` of its queue on; the queue owns tokens ``low`` to ``high`` of all.
    """
    windows = -(-total // window)
    quantum = (high - low) * (window / total)
    # What a queue has given is never more than a token from its share, so these windows are enough.
    first = np.clip(np.floor((at - 2) / quantum).astype(np.int64) - 1, 0, windows - 1)
    last = np.clip(np.ceil((at + n + 2) / quantum).astype(np.int64) + 1, 1, windows)
    counts = last - first
    doc = np.repeat(np.arange(len(n)), counts)
    w = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + first[doc]
    begin, end = w * window, np.minimum((w + 1) * window, total)
    above = share(begin, low[doc], total)
    given = share(begin, high[doc], total) - above
    offset = share(end, low[doc], total) - above
    until = share(end, high[doc], total) - above - offset
    start, stop = np.maximum(given, at[doc]), np.minimum(until, (at + n)[doc])
    full = stop > start
    return doc[full], (start - at[doc])[full], (stop - start)[full], w[full], (offset + start - given)[full]


def coded(docs: DataFrame, encoder: Callable[[], Callable], end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """A written table of the documents' ids, where each knows the tokens of its source before it in its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, held = encoder(), TaskContext.get().partitionId(), {}
        for batch in slices(batches, "text"):
            ids, sizes = encode(pc.fill_null(batch.column("text"), ""))
            closed = np.insert(ids.astype("<u4"), np.cumsum(sizes), end_id)
            sizes, earlier = sizes.astype(np.int64) + 1, []
            for source, n in zip(batch.column("source").to_pylist(), sizes.tolist(), strict=True):
                earlier.append(held.get(source, 0))
                held[source] = earlier[-1] + n
            ends = np.concatenate([[0], np.cumsum(sizes * 4)]).astype(np.int32)
            raw = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(closed)])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("source"), pa.array(np.full(len(sizes), part, np.int32)), pa.array(earlier, pa.int64()),
                pa.array(sizes), raw,
            ], schema=_CODED)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"))
    path = new_path(docs.sparkSession, "coded")
    rows.mapInArrow(run, _CODED_SCHEMA).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(_CODED_SCHEMA).parquet(path)


def _queues(table: DataFrame, total: int, window: int) -> DataFrame:
    """(q_source, q_part, q_before, low, high): where the tokens of a source in a part begin among all, and the bounds of their queue."""
    sums = table.groupBy("source", "part").agg(F.sum("n").alias("tokens"))
    own = sums.groupBy("source").agg((F.sum("tokens") * window < total).alias("small")).withColumnRenamed("source", "_source")
    sums = sums.join(own, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    order = [F.col("small"), F.col("source").asc_nulls_last(), F.col("part")]
    placed = Ordered(sums, [], order).running_sum(F.col("tokens"), "through").done().withColumn("q_before", F.col("through") - F.col("tokens"))
    bounds = placed.groupBy("source", "small").agg(F.min("q_before").alias("low"), F.max("through").alias("high"))
    edge, last = bounds.agg(F.min(F.when(F.col("small"), F.col("low"))), F.max(F.when(~F.col("small"), F.col("low")))).first()
    if edge is None:
        edge = total
    elif (total - edge) * window < total:
        # All small sources together have less than a token per window: they end the last other queue.
        edge = last
    shared = F.col("low") >= edge
    bounds = bounds.select(
        F.col("source").alias("_source"), F.when(shared, F.lit(edge)).otherwise(F.col("low")).alias("low"),
        F.when(shared, F.lit(total)).otherwise(F.col("high")).alias("high"),
    )
    placed = placed.join(bounds, F.col("source").eqNullSafe(F.col("_source")))
    return placed.select(F.col("source").alias("q_source"), F.col("part").alias("q_part"), "q_before", "low", "high")


def packed(
    docs: DataFrame, encoder: Callable[[], Callable], end_id: int, window: int = WINDOW,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """doc_id, source, start, length, doc_tokens, sequence_id, offset, ids: one row per piece of a document in a window.

    ``encoder`` gives in each task a function from texts to (ids, sizes); ``end_id`` ends each document, so that a null or empty text has
    that id alone. Each id lies in exactly one piece, ``ids`` has a piece's as little-endian unsigned 32-bit integers, ``start`` counts the
    document's ids before it. Windows are numbered from 0, filled without gaps and all full but the last. A source's documents follow each other
    as they are read. Null is a source of its own; repeated rows and those without an id are packed like others. Other columns are not read.
    An empty table gives an empty result.
    """
    table = coded(docs, encoder, end_id, id_col, text_col, source_col)
    total = int(table.agg(F.sum("n")).first()[0] or 0)
    if total > MOST_TOKENS:
        raise ValueError(f"more than {MOST_TOKENS} tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            at, n, low, high = (np.asarray(batch.column(c)) for c in ("at", "n", "low", "high"))
            doc, start, length, w, offset = pieces_of(at, n, low, high, total, window)
            # The pieces of a batch are its ids in order, so they share its buffer.
            ids = batch.column("ids")
            begin = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + 1]
            ends = np.concatenate([begin, begin[0] + np.cumsum(length * 4)]).astype(np.int32)
            raw = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends), ids.buffers()[2]])
            rows = pa.array(doc)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(rows), batch.column("source").take(rows), pa.array(start), pa.array(length), pa.array(n[doc]),
                pa.array(w), pa.array(offset), raw,
            ], names=["doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    queues = cut(_queues(table, total, window))
    # Few rows go to all tasks, so that the ids stay where they are; with more parts and sources they meet by a join.
    queues = F.broadcast(queues) if queues.count() <= BROADCAST_ROWS else queues.hint("merge")
    met = table.join(queues, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("part") == F.col("q_part")))
    at = (F.col("q_before") + F.col("earlier") - F.col("low")).alias("at")
    return met.select("doc_id", "source", "n", "ids", at, "low", "high").mapInArrow(run, PIECE_SCHEMA)
