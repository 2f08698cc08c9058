"""Words, n-gram keys and batch slices, vectorised over Arrow columns.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D. Null text counts as empty.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 4_000_000
WORD = r"[^\x20\x09-\x0D]+"


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of at most ``most`` bytes of text; a longer text is a run of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            base = ends[start] - sizes[start]
            stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop
        trim()


def trim() -> None:
    """Give freed memory back, as workers live on from task to task and from stage to stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


#: ASCII letters lower-cased, digits as they are, all other signs of ASCII a space.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def folded(texts: pa.Array) -> pa.Array:
    """The texts with a space for each sign of ASCII but letters and digits, lower-cased in A-Z, so that words are terms. Null is empty."""
    texts = pc.fill_null(texts, "")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = b"" if texts.buffers()[2] is None else texts.buffers()[2].slice(ends[0], ends[-1] - ends[0]).to_pybytes()
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(raw.translate(_FOLD)))


class Words:
    """The words of an array of texts.

    ``codes`` has one number per word, in order; ``starts`` has where each text's words
    begin, and the total at its end; ``distinct`` has the word that each code stands for.
    """

    def __init__(self, texts: pa.Array, lower: bool = True):
        texts = pc.fill_null(texts, "")
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
        flat = lists.flatten()
        ends = np.asarray(lists.offsets, dtype=np.int64)
        ends = ends - ends[0]
        full = np.asarray(pc.not_equal(pc.binary_length(flat), 0))
        before = np.concatenate([[0], np.cumsum(full)])
        self.starts = before[ends]
        coded = flat.filter(pa.array(full)).dictionary_encode()
        self.codes = np.asarray(coded.indices, dtype=np.int64)
        self.distinct = coded.dictionary

    def sizes(self) -> np.ndarray:
        return np.diff(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each distinct word."""
        h = xxhash.xxh3_64_intdigest
        return np.fromiter((h(w) for w in self.distinct.to_pylist()), np.uint64, len(self.distinct))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a sequence ``left`` lengthened by ``right``."""
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + right + np.uint64(1))


def shingle_sets(words: Words, size: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its ``size``-word shingles.

    A text of fewer words has its whole sequence as the one shingle; one without words has none.
    """
    hashed = mix(words.hashes() + np.uint64(0x632BE59BD9B4E019))[words.codes] if len(words.codes) else np.empty(0, np.uint64)
    grams = hashed
    for k in range(1, size):
        grams = joined(grams[: max(0, len(hashed) - k)], hashed[k:])
    for start, stop in zip(words.starts[:-1], words.starts[1:], strict=True):
        n = stop - start
        if n >= size:
            yield np.unique(grams[start : stop - size + 1])
        elif n:
            whole = hashed[start : start + 1]
            for k in range(1, n):
                whole = joined(whole, hashed[start + k : start + k + 1])
            yield mix(whole + np.uint64(n))
        else:
            yield hashed[:0]


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that no name of theirs meets one of an operator."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def row_key(df: DataFrame) -> list[Column]:
    """128 bits that equal rows share, in columns key_1 and key_2."""
    plain = [F.to_json(f"`{f.name}`") if isinstance(f.dataType, (T.MapType, T.VariantType)) else F.col(f"`{f.name}`") for f in df.schema]
    # Which columns are null is hashed too, as a null leaves a hash as it is.
    nulls = F.concat(*[F.col(f"`{c}`").isNull().cast("string") for c in df.columns])
    return [F.xxhash64(F.lit(i), nulls, *plain).alias(f"key_{i}") for i in (1, 2)]
