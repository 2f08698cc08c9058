"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Every whole text becomes a fixed number of statistics. Random Fourier features of the standardised statistics approximate a
Gaussian kernel (Rahimi and Recht, 2007); the normal equations of ridge regression on them are sums, so each task adds up
its own and only matrices of fixed size come together. Scores are calibrated by pooling adjacent violators over a
histogram of fixed width, again a sum over tasks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from . import words as words_module
from .words import Words, slices

FEATURES, BINS, GROUPS = 256, 512, 16
STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "distinct_share", "top_share", "pair_share", "upper", "digits", "spaces", "marks", "signs",
    "end_signs", "short_words", "long_words", "lines", "distinct_lines", "line_bytes", "other_bytes", "sentence_words",
)

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(words_module)


def _classes() -> np.ndarray:
    """Per byte a bit mask: upper case, digit, white space, common marks, other signs, not ASCII, line break, sentence end."""
    out = np.zeros(256, np.uint8)
    for bit, chars in enumerate((
        b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\v\f", b".,;:'\"-()", b"!?#$%&*+/<=>@[\\]^_`{|}~", bytes(range(128, 256)), b"\n", b".!?",
    )):
        out[list(chars)] |= 1 << bit
    return out


_CLASS = _classes()


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` for each text; null counts as empty. All of a text is read."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    sizes = np.asarray(pc.binary_length(texts), np.int64)
    ends = np.cumsum(sizes)
    raw = np.frombuffer(b"".join(t.as_buffer().to_pybytes() for t in texts), np.uint8)
    marks = _CLASS[raw]
    before = np.zeros(len(raw) + 1, np.int64)

    def per_text(hits: np.ndarray) -> np.ndarray:
        np.cumsum(hits, out=before[1:])
        return before[ends] - before[ends - sizes]

    kinds = [per_text((marks >> b) & 1) for b in range(8)]
    words = Words(texts, lower=True)
    count = words.sizes()
    text_of = np.repeat(np.arange(n), count)
    length = np.asarray(pc.binary_length(words.distinct), np.int64)[words.codes] if len(words.codes) else np.empty(0, np.int64)
    last = np.fromiter((ord(w[-1]) if w[-1] < "\x80" else 128 for w in words.distinct.to_pylist()), np.int64, len(words.distinct))
    signs = ((_CLASS[last] >> 4) & 1)[words.codes] if len(words.codes) else np.empty(0, np.int64)

    def sums(values: np.ndarray) -> np.ndarray:
        return np.bincount(text_of, weights=values, minlength=n)

    def repeats(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of each text, and how often its most frequent key occurs."""
        if not len(keys):
            return np.zeros(n), np.zeros(n)
        order = np.lexsort((keys, owner))
        k, o = keys[order], owner[order]
        starts = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])]))
        runs, most = np.diff(np.append(starts, len(k))), np.zeros(n)
        np.maximum.at(most, o[starts], runs)
        return np.bincount(o[starts], minlength=n).astype(float), most

    distinct, most = repeats(words.codes, text_of)
    inside = np.flatnonzero(text_of[1:] == text_of[:-1]) if len(text_of) else np.empty(0, np.int64)
    pairs, _ = repeats(words.codes[inside] * (len(words.distinct) + 1) + words.codes[inside + 1], text_of[inside])
    lines = pc.split_pattern(texts, "\n")
    line_count = np.diff(np.asarray(lines.offsets, np.int64))
    line_codes = np.asarray(lines.flatten().dictionary_encode().indices, np.int64)
    distinct_lines, _ = repeats(line_codes, np.repeat(np.arange(n), line_count))
    some, bytes_ = np.maximum(count, 1), np.maximum(sizes, 1)
    columns = [
        np.log1p(sizes), np.log1p(count), sums(length) / some, distinct / some, most / some, pairs / np.maximum(count - 1, 1),
        kinds[0] / bytes_, kinds[1] / bytes_, kinds[2] / bytes_, kinds[3] / bytes_, kinds[4] / bytes_, sums(signs) / some,
        sums(length <= 2) / some, sums(length >= 16) / some, np.log1p(line_count), distinct_lines / line_count,
        np.log1p(sizes / line_count), kinds[5] / bytes_, np.log1p(count / (kinds[7] + 1)),
    ]
    return np.stack(columns, axis=1).astype(np.float64)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            x = statistics(part.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "x"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, x array<double>")


def _rows(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _summed(df: DataFrame, size: int, part) -> np.ndarray:
    """The sum of ``part(batch)``, an array of ``size`` numbers, over all batches: per task, then per group, then whole."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for raw in batch.column("sums"):
                total += np.frombuffer(raw.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    grouped = df.mapInArrow(each, "sums binary").repartition(GROUPS).mapInArrow(merged, "sums binary")
    return np.sum([np.frombuffer(r.sums) for r in grouped.collect()], axis=0)


@dataclass
class Model:
    """What a fit leaves: of fixed size, whatever it was fitted on."""

    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    shifts: np.ndarray
    ridge: np.ndarray
    levels_at: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        return np.hstack([np.cos(z @ self.weights + self.shifts), z, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.ridge, -0.5, 1.5)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.levels_at, self.levels), 0.0, 1.0)


def pooled(at: np.ndarray, good: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of good / count over ``at``: the weighted middle and the level of each pool, in order."""
    pools: list[list[float]] = []
    for a, g, c in zip(at, good, count, strict=True):
        if not c:
            continue
        pools.append([a * c, g, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            top = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], top, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fit(labelled: DataFrame, features: int = FEATURES, width: float = 4.0, penalty: float = 1e-3, seed: int = 7) -> Model:
    """A model from rows (x, label); label is 0 or 1. Every row takes part; nothing but sums of fixed size leaves the tasks."""
    labelled = cut(labelled.select("x", F.col("label").cast("double").alias("label")))
    d = len(STATISTICS)
    sums = _summed(labelled, 2 * d + 1, lambda b: np.concatenate([(x := _rows(b.column("x"))).sum(0), (x**2).sum(0), [len(x)]]))
    n = max(sums[-1], 1.0)
    mean = sums[:d] / n
    deviation = np.sqrt(np.maximum(sums[d : 2 * d] / n - mean**2, 1e-8))
    rng = np.random.default_rng(seed)
    weights, shifts = rng.normal(0, 1 / width, (d, features)), rng.uniform(0, 2 * np.pi, features)
    size = features + d + 1
    model = Model(mean, deviation, weights, shifts, np.zeros(size), np.array([0.5]), np.array([0.5]))

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        f, y = model.features(_rows(batch.column("x"))), np.asarray(batch.column("label"))
        return np.concatenate([(f.T @ f).ravel(), f.T @ y])

    whole = _summed(labelled, size * size + size, equations)
    if sums[-1]:
        model.ridge = np.linalg.solve(whole[: size * size].reshape(size, size) + penalty * n * np.eye(size) / 10, whole[size * size :])

    def histogram(batch: pa.RecordBatch) -> np.ndarray:
        r, y = model.raw(_rows(batch.column("x"))), np.asarray(batch.column("label"))
        at = np.minimum(((r + 0.5) / 2 * BINS).astype(np.int64), BINS - 1)
        return np.concatenate([np.bincount(at, r, BINS), np.bincount(at, y, BINS), np.bincount(at, minlength=BINS)])

    middle, good, count = _summed(labelled, 3 * BINS, histogram).reshape(3, BINS)
    if sums[-1]:
        model.levels_at, model.levels = pooled(middle / np.maximum(count, 1), good, count)
    return model


def model_of(
    docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
    measures: DataFrame | None = None, **options,
) -> Model:
    """The model that ``classified`` scores with. ``measures`` may hold what ``measured(docs)`` gives."""
    x = measured(docs, id_col, text_col) if measures is None else measures
    marks = labels.where("id is not null and label is not null").groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    chosen = x.where(~F.coalesce(held_out, F.lit(False)))
    return fit(chosen.join(marks, x["doc_id"] == marks["id"]).select("x", "label"), **options)


def with_scores(docs: DataFrame, model: Model, score_col: str, text_col: str = "text") -> DataFrame:
    """``docs`` and the score of each row, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            scores = model.scores(statistics(part.column(text_col)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], names=[*part.schema.names, score_col])

    if score_col in docs.columns:
        raise ValueError(f"there is a column {score_col} already")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def classified(
    docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``.

    ``labels`` (id, label) marks documents; null ids and labels say nothing, an id with several labels counts as 1 if most are. The fit takes
    the labelled rows where ``held_out`` is not true; a score depends on the text alone. Null text is empty; an empty text is scored as any other.
    Without labels each score is 0.5. Other columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    x = cut(measured(rows))
    flags = F.coalesce(held_out, F.lit(False))
    model = model_of(rows, labels, held_out, measures=x, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(model.scores(_rows(batch.column("x"))))],
                    names=["doc_id", "held_out", "score"],
                )

    scored = x.select("doc_id", flags.alias("held_out"), "x").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
