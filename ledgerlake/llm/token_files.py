"""Token ids in chunks of byte or bit planes.

A shard holds the ids of a range of documents in order, cut into blocks of a fixed number of ids. Each block is
transposed into planes, each plane is compressed on its own, and the row of the block is its entry in the chunk index: where it
starts in its shard, how many ids it has, and which documents begin in it. The rows are a Parquet table, so it can lie in any store.
Planes of high bits are all but constant, so they cost next to nothing.
"""

from __future__ import annotations

import os
import sys
import types
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words as words_module
from .words import slices

BLOCK_IDS = 65_536
CHUNK_SCHEMA = (
    "shard long, chunk long, start_in_shard long, n_ids int, first_doc long, doc_ids array<long>, doc_sizes array<long>, "
    "plane_sizes array<int>, planes binary"
)

_CHUNK = pa.schema([
    ("shard", pa.int64()), ("chunk", pa.int64()), ("start_in_shard", pa.int64()), ("n_ids", pa.int32()), ("first_doc", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_sizes", pa.list_(pa.int64())), ("plane_sizes", pa.list_(pa.int32())), ("planes", pa.binary()),
])

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(words_module)


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The planes of 32-bit ids, lowest first: 4 of bytes, or 32 of bits."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [p.tobytes() for p in raw.T]
    return [np.packbits(p).tobytes() for p in np.unpackbits(raw, axis=1, bitorder="little").T]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        flat = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
        raw = np.packbits(flat, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


class WordEncoder:
    """An encoder of texts for a lower-casing tokenizer that drops white space and never looks across it.

    Each distinct word is encoded once, without the signs at its end, many in one call; the ids of texts are put
    together from these. Only texts with marks of special tokens are taken word by word as they stand.
    """

    #: Signs that are one part of their own behind a letter, as the tokenizer splits words.
    SIGNS = ".,;:!?#$%&*|"
    #: Words an encoder remembers, and words per call.
    MOST, JOINED = 1_000_000, 256

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        # Word number i owns flat[ends[i] : ends[i + 1]]; both grow in place.
        self.ends, self.flat = array("q", [0]), array("i")

    def _remember(self, words: list[str], sizes: np.ndarray, ids: list[int]) -> None:
        first = len(self.ends) - 1
        self.known.update(zip(words, range(first, first + len(words)), strict=True))
        self.ends.frombytes((np.cumsum(sizes, dtype=np.int64) + self.ends[-1]).tobytes())
        self.flat.extend(ids)

    def _learn(self, words: list[str]) -> None:
        plain, single = [], []
        for word in words:
            (plain if word.isalpha() else single).append(word)
        for low in range(0, len(plain), self.JOINED):
            part = plain[low : low + self.JOINED]
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            owner = got.word_ids
            if not owner or owner[-1] != len(part) - 1:
                single += part
            else:
                self._remember(part, np.bincount(owner, minlength=len(part)), got.ids)
        for word in single:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            self._remember([word], np.array([len(ids)]), ids)

    def _parts(self, words: pa.Array, special: bool) -> tuple[pa.Array, pa.Array, list[str]]:
        """The stems of words; which words have signs behind the stem; those signs."""
        if special:
            return words, pa.array(np.zeros(len(words), bool)), []
        stems = pc.utf8_rtrim(words, characters=self.SIGNS)
        cuts = pc.and_(pc.not_equal(pc.binary_length(stems), pc.binary_length(words)), pc.match_substring_regex(stems, r"[\p{L}\p{N}]$"))
        whole, left = words.filter(cuts).to_pylist(), stems.filter(cuts).to_pylist()
        return pc.if_else(cuts, stems, words), cuts, [w[len(s) :] for w, s in zip(whole, left, strict=True)]

    def _numbers(self, words: pa.Array) -> np.ndarray:
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        found = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(found < 0).tolist()
        if new:
            new = [distinct[i] for i in new]
            self._learn(new)
            found[found < 0] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        return found[np.asarray(coded.indices)]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        special = pc.any(pc.match_substring(texts, "<|")).as_py()
        words = words_module.Words(texts, lower=not special)
        if len(self.known) > self.MOST:
            self._forget()
        stems, cuts, tails = self._parts(words.distinct, special)
        at = np.zeros((len(stems), 2), np.int64)
        at[:, 0] = self._numbers(stems)
        cuts = np.asarray(cuts)
        at[cuts, 1] = self._numbers(pa.array(tails, pa.string()))
        # Copies, as an array that is looked at cannot grow.
        ends, flat = np.array(self.ends, np.int64), np.array(self.flat, np.int32)
        sizes = ends[at + 1] - ends[at]
        sizes[~cuts, 1] = 0
        ids, stops = _gathered(flat, ends[at].ravel(), sizes.ravel())
        first = stops[:-1:2]
        every, stops = _gathered(ids, first[words.codes], (stops[2::2] - first)[words.codes])
        return every, np.diff(stops[words.starts])


def shared_encoder(path: str) -> WordEncoder:
    """The encoder of this worker process for the file, which lives on from task to task with the words it remembers."""
    held = sys.modules.setdefault("_ledgerlake_encoders", types.ModuleType("_ledgerlake_encoders")).__dict__
    if path not in held:
        held[path] = WordEncoder(path)
    return held[path]


def _gathered(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``sizes`` values from ``first``, one after the other, and where each begins (with the total last)."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return flat[np.repeat(first - ends[:-1], sizes) + np.arange(ends[-1])], ends


class _Shard:
    """Ids of one shard on their way into blocks."""

    def __init__(self, shard: int, block: int, bits: bool, level: int):
        self.shard, self.block, self.bits = shard, block, bits
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int, int]] = []
        self.held, self.start, self.chunk, self.doc = 0, 0, 0, 0
        self.zip = zstandard.ZstdCompressor(level=level)

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append((doc_id, len(ids), self.start + self.held))
        self.ids.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            yield from self.blocks(False)

    def blocks(self, last: bool) -> Iterator[tuple]:
        ids = np.concatenate(self.ids) if self.ids else np.empty(0, np.uint32)
        at = 0
        while len(ids) - at >= self.block or last and at < len(ids):
            part = ids[at : at + self.block]
            planes = [self.zip.compress(p) for p in to_planes(part, self.bits)]
            n = sum(begin < self.start + len(part) for _, _, begin in self.docs)
            here, self.docs = self.docs[:n], self.docs[n:]
            yield (
                self.shard, self.chunk, self.start, len(part), self.doc, [d for d, _, _ in here], [s for _, s, _ in here],
                [len(p) for p in planes], b"".join(planes),
            )
            self.doc += n
            self.chunk += 1
            self.start += len(part)
            at += len(part)
        self.ids, self.held = [ids[at:]], len(ids) - at


def encoded_chunks(
    docs: DataFrame, encoder: Callable[[], Callable], end_id: int, id_col: str = "doc_id", text_col: str = "text",
    block: int = BLOCK_IDS, bits: bool = False, level: int = 3, shard_bytes: int = 32 << 20,
) -> DataFrame:
    """The chunk rows of all documents in order of their ids.

    ``encoder`` is called in each task and gives a function from texts to (ids, sizes). Null text is empty; each document
    is followed by ``end_id``, so an empty one has that id alone. Rows of one id follow each other in order of a hash of
    their text; rows without an id come first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder()
        shard = _Shard(TaskContext.get().partitionId(), block, bits, level)

        def rows(out: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _CHUNK, strict=True)]
            return pa.RecordBatch.from_arrays(columns, schema=_CHUNK)

        for part in slices(batches, "text"):
            ids, sizes = encode(pc.fill_null(part.column("text"), ""))
            ends = np.cumsum(sizes)
            out: list[tuple] = []
            closed = np.insert(ids.astype(np.uint32), ends, end_id)
            ends = ends + np.arange(1, len(ends) + 1)
            for doc_id, begin, end in zip(part.column("doc_id").to_pylist(), np.concatenate([[0], ends[:-1]]), ends, strict=True):
                out.extend(shard.add(doc_id, closed[begin:end]))
            if out:
                yield rows(out)
        out = list(shard.blocks(True))
        if out:
            yield rows(out)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    source = source.withColumn("_tie", F.xxhash64("text"))
    parts = _shards(source, shard_bytes)
    placed = source.repartitionByRange(parts, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    return placed.select("doc_id", "text").mapInArrow(run, CHUNK_SCHEMA)


def _shards(texts: DataFrame, shard_bytes: int) -> int:
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(size // shard_bytes) + 1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def write(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("errorifexists").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK_SCHEMA).parquet(path)


def shard_starts(chunks: DataFrame) -> DataFrame:
    """(shard, before): the number of ids in the shards before each; one row per shard is all that is summed up in one place."""
    sizes = chunks.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("before"))


def documents(chunks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the chunk rows, in any order.

    A shard's chunks meet in one task in their order, which holds one block and the open document at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        waiting: list[tuple[int | None, int]] = []
        open_ids, held, begin = [], 0, 0
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if row["chunk"] == 0:
                    waiting, open_ids, held, begin = [], [], 0, row["before"]
                raw, planes = row["planes"], []
                for size in row["plane_sizes"]:
                    planes.append(unzip.decompress(raw[:size]))
                    raw = raw[size:]
                open_ids.append(from_planes(planes, row["n_ids"]))
                held += row["n_ids"]
                waiting += zip(row["doc_ids"], row["doc_sizes"], strict=True)
                if not waiting or held < waiting[0][1]:
                    continue
                ids, at, done = np.concatenate(open_ids), 0, 0
                for doc_id, n in waiting:
                    if at + n > len(ids):
                        break
                    out.append((doc_id, begin, n, zlib.crc32(ids[at : at + n].astype("<u4").tobytes())))
                    at, begin, done = at + n, begin + n, done + 1
                waiting, open_ids, held = waiting[done:], [ids[at:]], len(ids) - at
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    placed = chunks.join(shard_starts(chunks), "shard")
    wanted = ["shard", "chunk", "before", "n_ids", "doc_ids", "doc_sizes", "plane_sizes", "planes"]
    placed = placed.select(*wanted).repartition("shard").sortWithinPartitions("shard", "chunk")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
