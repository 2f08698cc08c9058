"""MinHash near-dedup: one-permutation hashing with optimal densification, bands, and stars.

Every document is reduced to the set of its word shingles. Documents of equal sets form a
class; one member stands for it from there on, so copies, however many, never meet in pairs.
One hash per shingle fills all bins of a class's signature, and empty bins borrow from full ones
(Shrivastava, 2017, "Optimal Densification for Fast and Accurate Minwise Hashing"). Classes that
agree in a band share a bucket, and each bucket is a star: its members are compared, on full sets, with one centre.

A star leaves open how those members are linked that are not linked with its centre. The classes of buckets that do not lie within one
component therefore meet once more, by the rarest shingles that linked sets must share. Again each such
key has stars, of one centre, then of more, and only pairs of different components whose places in the common order allow the
similarity are made. A centre leaves its key afterwards, as all its pairs there are settled. This goes on until every key
lies within one component, so no link between classes of a bucket is lost, and pairs inside a component are never made.

A pair of similarity 0.85 misses all 25 bands of five bins with probability 4e-7, one of 0.8 with 5e-5.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..session import cut
from . import words as words_module
from .words import Words, mix, shingle_sets, slices

ROWS, BANDS = 5, 25
#: The rows of a key are dealt over so many tasks by their nodes.
SALTS = 32
#: Centres per key grow by this factor from round to round.
GROWTH = 16

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(words_module)


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))


def _told(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Salted rows (key, salt, node, ...) with the facts of their key, those without facts left out.

    Facts go to the salts that a key has, so the rows of a key that a family of near copies or a line of boilerplate
    fills never meet in one task.
    """
    return rows.join(rows.select("key", "salt").distinct().join(facts, "key"), ["key", "salt"])


def densified(shingles: np.ndarray, bins: int) -> np.ndarray:
    """The one-permutation signature of a non-empty sorted set of 64-bit hashes.

    A bin holds the smallest hash that falls into it. An empty bin takes the value of the first full bin
    that its own fixed random sequence of bins meets.
    """
    at = ((shingles >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    at = at.astype(np.int64)
    first = np.concatenate([[True], at[1:] != at[:-1]])
    signature, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    signature[at[first]] = shingles[first]
    full[at[first]] = True
    empty, step, own = np.flatnonzero(~full), 0, np.arange(32, dtype=np.uint64)
    while len(empty):
        seeds = mix((empty.astype(np.uint64)[:, None] << np.uint64(32)) + own + np.uint64(32 * step + 1))
        donors = (seeds % np.uint64(bins)).astype(np.int64)
        hit = full[donors]
        found = hit.any(axis=1)
        signature[empty[found]] = signature[donors[found, hit[found].argmax(axis=1)]]
        empty, step = empty[~found], step + 1
    return signature


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One key for each run of ``rows`` bins; the band's number is part of the key."""
    grid = signature.reshape(-1, rows)
    keys = np.arange(len(grid), dtype=np.uint64)
    for column in grid.T:
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    return int(shingles.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mix(shingles + np.uint64(0x2545F4914F6CDD1D)), initial=0))


def _signed(values) -> np.ndarray:
    return np.asarray(values, np.uint64).view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, rows: int, bands: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, keys) of every row; ``keys`` is empty where there are no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            n, f1, f2, keys, ends = [], [], [], [], [0]
            for s in shingle_sets(Words(part.column("text")), size):
                n.append(len(s))
                a, b = fingerprint(s)
                f1.append(a)
                f2.append(b)
                if len(s):
                    keys.append(band_keys(densified(s, rows * bands), rows))
                ends.append(ends[-1] + (bands if len(s) else 0))
            flat = np.concatenate(keys) if keys else np.empty(0, np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_signed(flat)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(_signed(f1)), pa.array(_signed(f2)), lists],
                names=["doc_id", "n_shingles", "f1", "f2", "keys"],
            )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>")


def _sets(rows: DataFrame, size: int) -> DataFrame:
    """(node, f1, f2, shingles) of the rows (node, f1, f2, text) whose set has that fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            wanted = zip(part.column("f1").to_pylist(), part.column("f2").to_pylist(), strict=True)
            keep, out = [], []
            for i, (s, want) in enumerate(zip(shingle_sets(Words(part.column("text")), size), wanted, strict=True)):
                if tuple(_signed(fingerprint(s)).tolist()) == want:
                    keep.append(i)
                    out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays(
                [*part.select(["node", "f1", "f2"]).take(pa.array(keep, pa.int64())).columns, pa.array(out, pa.binary())],
                names=["node", "f1", "f2", "shingles"],
            )

    return rows.mapInArrow(run, "node long, f1 long, f2 long, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """The pairs (u, v) whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, left = None, np.empty(0, np.uint64)
            ok = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                raw = a.as_buffer()
                if held is None or not raw.equals(held):
                    held, left = raw, np.frombuffer(raw, np.uint64)
                right = np.frombuffer(b.as_buffer(), np.uint64)
                small, large = sorted((len(left), len(right)))
                if 100 * small < per_cent * large:
                    ok.append(False)
                    continue
                both = len(np.intersect1d(left, right, assume_unique=True))
                ok.append(100 * both >= per_cent * (small + large - both))
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    a = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long").distinct()


def _rare_first(sets: DataFrame, per_cent: int) -> DataFrame:
    """(key, node, n, place): the shingles of each set, rarest first, as far as a linked set has to meet one of them.

    Of two linked sets each holds at least ``per_cent`` of the other's size in common, so they meet among the first
    n - per_cent * n / 100 + 1 of a common order (Chaudhuri, Ganti and Kaushik, 2006, "A Primitive Operator for Similarity Joins").
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, f1, raw in zip(batch.column("node").to_pylist(), batch.column("f1").to_pylist(), batch.column("shingles"), strict=True):
                h = np.frombuffer(raw.as_buffer(), np.int64)
                columns = [pa.array(np.full(len(h), x, np.int64)) for x in (node, f1, len(h))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(h)], names=["node", "f1", "n", "key"])

    listed = sets.select("node", "f1", "shingles").mapInArrow(run, "node long, f1 long, n long, key long")
    used = listed.groupBy("key").agg(F.count(F.lit(1)).alias("used"))
    placed = _told(_salted(listed), used).withColumn("place", F.expr("row_number() over (partition by node, f1 order by used, key)"))
    needed = F.col("n") - F.ceil(F.col("n") * per_cent / 100) + 1
    return placed.where((F.col("place") <= needed) & (F.col("used") > 1)).select("key", "salt", "node", "n", "place")


def _open(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The salted rows (key, salt, node, ...) with the labels of their nodes, of the keys that hold several labels."""
    if labels is None:
        left = rows.withColumn("label", F.col("node"))
    else:
        left = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = left.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    return _told(left, several.select("key"))


class _Links:
    """Links found so far and the components they make."""

    def __init__(self, sets: DataFrame, per_cent: int):
        self.sets, self.per_cent = sets, per_cent
        self.labels: DataFrame | None = None

    def add(self, met: DataFrame) -> None:
        """Confirm the pairs (node, c)."""
        pairs = met.select(F.least("node", "c").alias("u"), F.greatest("node", "c").alias("v")).distinct()
        found = cut(_confirmed(pairs, self.sets, self.per_cent))
        if found.isEmpty():
            return
        if self.labels is not None:
            before = self.labels.where("node <> label").select(F.col("label").alias("u"), F.col("node").alias("v"))
            found = found.unionByName(before)
        self.labels = cut(components(found))


def links_of(buckets: DataFrame, sets: DataFrame, per_cent: int, growth: int = GROWTH) -> DataFrame | None:
    """(node, label) of all nodes that are linked with another; None without any link.

    ``buckets`` (key, salt, node, n) holds no key with one node only. See the module's text for the two steps.
    """
    links = _Links(sets, per_cent)
    centres = buckets.groupBy("key").agg(F.min(F.struct("node", "n")).alias("c")).select("key", "c.node", "c.n").toDF("key", "c", "c_n")
    sizes = F.least("n", "c_n") * 100 >= F.greatest("n", "c_n") * per_cent
    links.add(_told(buckets, centres).where((F.col("node") != F.col("c")) & sizes))
    unsettled = _open(buckets, links.labels).select("node").distinct()
    rows = cut(_rare_first(sets.join(unsettled, "node", "left_semi"), per_cent))
    centres_per_key, done = 1, None
    while True:
        left = rows if done is None else rows.join(done, ["key", "node"], "left_anti")
        left = cut(_open(left, links.labels).select("key", "salt", "node", "n", "place", "label"))
        if left.isEmpty():
            return links.labels
        # Few centres are the first of a key among the first of each salt; of many, each salt has its share, so no task ranks a whole key.
        share = centres_per_key // SALTS or centres_per_key
        ranked = left.withColumn("r", F.expr("row_number() over (partition by key, salt order by place, node)")).where(F.col("r") <= share)
        if share == centres_per_key:
            ranked = ranked.withColumn("r", F.expr("row_number() over (partition by key order by place, node)"))
        centres = cut(ranked.where(F.col("r") <= centres_per_key).select(
            "key", F.col("node").alias("c"), F.col("label").alias("c_label"), F.col("n").alias("c_n"), F.col("place").alias("c_place")
        ))
        # At the first shingle that two sets share, what is left of each bounds what they have in common.
        most = F.least(F.col("n") - F.col("place"), F.col("c_n") - F.col("c_place")) + 1
        possible = (F.col("label") != F.col("c_label")) & (most * 100 >= (F.col("n") + F.col("c_n") - most) * per_cent)
        links.add(_told(left, centres).where(possible))
        rows, done = left.drop("label"), centres.select("key", F.col("c").alias("node")).distinct()
        centres_per_key *= growth


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, per_cent: int = 80,
    rows: int = ROWS, bands: int = BANDS,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    Two documents are linked when 100 * |A & B| >= per_cent * |A | B| for their sets of ``size``-word shingles of the
    text with A-Z lower-cased. ``component_id`` is the smallest id reachable over links, the own one included, and
    ``kept`` tells whether it is the own one.

    Null text is empty; texts without words have no shingles and link with nothing. Rows of one id are one node of the graph,
    each with its own ``n_shingles``. A row without an id has no component and is kept. Other columns of ``docs`` are not read.
    An empty table gives an empty result.
    """
    signed = cut(signatures(docs, id_col, text_col, size, rows, bands))
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = cut(
        usable.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("node"), F.any_value("keys").alias("keys"))
    )
    spread = _salted(classes.select("node", F.col("n_shingles").alias("n"), F.explode("keys").alias("key")))
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    buckets = cut(_told(spread, shared))
    wanted = buckets.select("node").distinct().join(classes.select("node", "f1", "f2"), "node")
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text"))
    sets = cut(_sets(texts.join(wanted, "node").select("node", "f1", "f2", "text"), size))
    # Rows that repeat an id and its set give the set again; places in the common order count each set once.
    if not sets.groupBy("node", "f1", "f2").count().where("count > 1").isEmpty():
        sets = cut(sets.dropDuplicates(["node", "f1", "f2"]))
    labels = links_of(buckets, sets, per_cent)
    # Rows of one id with several texts tie the classes of these texts together.
    own = usable.join(classes.drop("keys"), ["f1", "f2", "n_shingles"]).select("doc_id", "node")
    if labels is None:
        labels = spread.sparkSession.createDataFrame([], "node long, label long")
    return _attach(signed, own, labels)


def _attach(signed: DataFrame, own: DataFrame, labels: DataFrame) -> DataFrame:
    named = own.join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("label"))
    twice = cut(named.distinct().groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")))
    ties = twice.where("label <> other").select(F.col("label").alias("u"), F.col("other").alias("v"))
    if not ties.isEmpty():
        ties = named.join(twice.where("label <> other").select("doc_id", F.col("label").alias("u")), "doc_id")
        merged = components(ties.select("u", F.col("label").alias("v"))).select(F.col("node").alias("label"), F.col("label").alias("low"))
        twice = twice.join(merged, "label", "left").withColumn("label", F.coalesce("low", "label"))
    label = twice.select("doc_id", "label")
    return signed.select("doc_id", "n_shingles").join(label, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"),
        F.coalesce(F.col("label") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
