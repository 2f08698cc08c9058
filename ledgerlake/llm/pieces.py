"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

A space becomes the marker U+2581 and a text gets one in front. As no piece has a marker behind another character, a text
can be cut before each run of markers that follows a word, and the best segmentation is that of its chunks. A batch solves each of its
distinct chunks once, many chunks of like length at a time: the trie walks from one start position for all of them together.
A character that no piece covers costs ten less than the worst piece and is written as its UTF-8 bytes.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as words_module
from .words import slices

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Bytes of chunks that are solved together; a chunk beyond it goes alone.
GROUP_BYTES = 1_000_000
#: Text that is solved at once; some hundred times as much memory is in use meanwhile.
SLICE_BYTES = 1_000_000

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(words_module)


def double_array(keys: list[bytes], values: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value of a trie of ``keys``: the child of s by byte b is t = base[s] + b if check[t] == s."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    keys, values = [keys[i] for i in order], [values[i] for i in order]
    cells: dict[int, tuple[int, int]] = {}
    base: dict[int, int] = {}
    used = bytearray(1 << 16)
    used[0] = 1
    # Nodes of several children go on where the last one fitted; those of one child fill the gaps.
    gap, wide, work = 1, 1, [(0, 0, len(keys), 0)]
    for node, low, high, depth in work:
        if low < high and len(keys[low]) == depth:
            cells[node] = (cells.get(node, (0, 0))[0], values[low])
            low += 1
        if low == high:
            continue
        firsts, codes = [], []
        for i in range(low, high):
            if not codes or keys[i][depth] != codes[-1]:
                firsts.append(i)
                codes.append(keys[i][depth])
        place = max(gap if len(codes) == 1 else wide, codes[0] + 1)
        while True:
            while (place := used.find(0, place)) < 0 or place + 256 >= len(used):
                place = max(place, 0) or len(used)
                used += bytes(len(used))
            at = place - codes[0]
            if not any(used[at + c] for c in codes):
                break
            place += 1
        if len(codes) == 1:
            gap = max(gap, place) if codes[0] + 1 <= gap else gap
        else:
            wide = place
        base[node] = at
        for c, first, stop in zip(codes, firsts, [*firsts[1:], high], strict=True):
            used[at + c] = 1
            cells[at + c] = (node, -1)
            work.append((at + c, first, stop, depth + 1))
    size = max([0, *cells]) + 257
    bases, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    bases[list(base)] = list(base.values())
    for cell, (parent, v) in cells.items():
        check[cell], value[cell] = parent, v
    return bases, check, value


@dataclass
class Pieces:
    """The pieces of a model with their trie."""

    texts: list[bytes]
    scores: np.ndarray
    byte_ids: np.ndarray | None
    unknown: int
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def load(cls, path: str) -> Pieces:
        """From a model file with identity normalisation and a marker put in front of texts."""
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in every]
        is_byte = [sp.is_byte(i) for i in every]
        texts, names, ids = [], [], []
        for i in every:
            piece = sp.id_to_piece(i)
            if is_byte[i]:
                texts.append(bytes([int(piece[3:5], 16)]))
                continue
            texts.append(b"" if special[i] else piece.replace(MARK, " ").encode())
            if not special[i]:
                if MARK in piece.lstrip(MARK):
                    raise ValueError("a piece has a marker behind another character")
                names.append(texts[-1])
                ids.append(i)
        in_order = {texts[i][0]: i for i in every if is_byte[i]}
        byte_ids = np.array([in_order[b] for b in range(256)], np.int32) if len(in_order) == 256 else None
        scores = np.array([sp.get_score(i) for i in every], np.float64)
        return cls(texts, scores, byte_ids, sp.unk_id(), *double_array(names, ids))

    def unknown_score(self) -> float:
        return float(self.scores[self.value[self.value >= 0]].min()) - UNKNOWN_PENALTY

    def solve(self, chunks: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the best segmentation of each row of a byte matrix, one row after the other, and their numbers.

        Of equal segmentations the one wins whose last piece starts first, then the same for what lies before it.
        """
        n, width = chunks.shape
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0.0
        rows, columns = np.arange(n), np.arange(width)
        # Where nothing better is known, a place is reached by the byte before it.
        came = np.tile(np.arange(-1, width), (n, 1)).astype(np.int32)
        by = np.full((n, width + 1), self.unknown, np.int32)
        if self.byte_ids is not None:
            by[:, 1:] = self.byte_ids[chunks]
        lead = np.where(chunks < 0x80, 1, np.where(chunks < 0xE0, 2, np.where(chunks < 0xF0, 3, 4)))
        penalty = self.unknown_score()
        for i in columns:
            live = rows[(i < sizes) & (best[:, i] > -np.inf)]
            char_end = i + lead[live, i]
            own = np.zeros(n, bool)
            at, start, node, end = live, best[live, i], np.zeros(len(live), np.int32), i
            while len(at):
                child = self.base[node] + chunks[at, end]
                ok = self.check[child] == node
                # The root's own entry is no child of it.
                ok &= child != 0
                at, start, node, end = at[ok], start[ok], child[ok], end + 1
                ids = self.value[node]
                hit = ids >= 0
                if hit.any():
                    r, total = at[hit], start[hit] + self.scores[ids[hit]]
                    better = total > best[r, end]
                    w = r[better]
                    best[w, end], came[w, end], by[w, end] = total[better], i, ids[hit][better]
                    own[r] |= i + lead[r, i] == end
                more = end < sizes[at]
                at, start, node = at[more], start[more], node[more]
            lost = live[~own[live]]
            if len(lost):
                end_of = np.minimum(char_end[~own[live]], sizes[lost])
                total = best[lost, i] + penalty
                better = total > best[lost, end_of]
                w, e = lost[better], end_of[better]
                best[w, e] = total[better]
                if self.byte_ids is None:
                    came[w, e], by[w, e] = i, self.unknown
                else:
                    came[w, e], by[w, e] = e - 1, self.byte_ids[chunks[w, e - 1]]
        out, count, place = np.zeros((n, width), np.int32), np.zeros(n, np.int64), sizes.copy()
        left = rows[place > 0]
        while len(left):
            here = place[left]
            out[left, width - 1 - count[left]] = by[left, here]
            count[left] += 1
            place[left] = came[left, here]
            left = left[place[left] > 0]
        return out[columns[None, :] >= width - count[:, None]], count

    def solve_all(self, raw: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of chunks, each ``sizes`` bytes of ``raw`` from ``first``: all ids, and for each chunk where its own begin and how many."""
        order = np.argsort(sizes, kind="stable")
        ids, begin, count, done, low = [], np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0, 0
        while low < len(order):
            high = low + 1
            while high < len(order) and sizes[order[high]] * (high + 1 - low) <= GROUP_BYTES and sizes[order[high]] <= 2 * sizes[order[low]] + 4:
                high = min(len(order), high + max(1, (high - low) // 4))
            own = order[low:high]
            width = int(sizes[own].max())
            grid = first[own][:, None] + np.arange(width)
            chunks = raw[np.minimum(grid, len(raw) - 1)]
            solved, n = self.solve(chunks, sizes[own].astype(np.int64))
            ids.append(solved)
            begin[own], count[own] = done + np.cumsum(n) - n, n
            done += len(solved)
            low = high
        return np.concatenate(ids) if ids else np.empty(0, np.int32), begin, count

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
        lists = pc.split_pattern(texts, " ")
        ends = np.asarray(lists.offsets, np.int64)
        ends = ends - ends[0]
        text_of = np.repeat(np.arange(len(texts)), np.diff(ends))
        text_of_size = np.asarray(pc.binary_length(texts), np.int64)
        coded = lists.flatten().dictionary_encode()
        codes = np.asarray(coded.indices, np.int64)
        sizes = np.asarray(pc.binary_length(coded.dictionary), np.int64)
        # Empty parts are further spaces; they join the part behind them, or stand alone at the end of a text.
        place = np.arange(len(codes))
        last = np.zeros(len(codes), bool)
        last[ends[1:] - 1] = True
        kept = (sizes[codes] > 0) | last
        before = np.where(kept, place, -1)
        previous = np.maximum.accumulate(np.concatenate([[-1], before[:-1]])) if len(codes) else before
        spaces = place - np.maximum(previous, ends[text_of] - 1)
        kept &= text_of_size[text_of] > 0
        codes, spaces, text_of = codes[kept], spaces[kept], text_of[kept]
        pairs, at = np.unique(spaces * (len(sizes) + 1) + codes, return_inverse=True)
        n_spaces, code = pairs // (len(sizes) + 1), pairs % (len(sizes) + 1)
        dictionary = coded.dictionary.to_pylist()
        joined = [b" " * int(s) + dictionary[c].encode() for s, c in zip(n_spaces, code, strict=True)]
        chunk_sizes = n_spaces + sizes[code]
        raw = np.frombuffer(b"".join(joined), np.uint8)
        ids, begin, count = self.solve_all(raw, np.cumsum(chunk_sizes) - chunk_sizes, chunk_sizes)
        each = count[at]
        stops = np.concatenate([[0], np.cumsum(each)])
        source = np.repeat(begin[at] - stops[:-1], each) + np.arange(stops[-1])
        return ids[source], np.bincount(text_of, weights=each, minlength=len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of runs of ids; bytes that are no UTF-8 become U+FFFD, the marker in front goes."""
        sizes = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        flat = np.frombuffer(b"".join(self.texts), np.uint8)
        each = sizes[ids]
        stops = np.concatenate([[0], np.cumsum(each)])
        raw = flat[np.repeat((np.cumsum(sizes) - sizes)[ids] - stops[:-1], each) + np.arange(stops[-1])].tobytes()
        ends = stops[np.cumsum(counts)]
        out = []
        for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
            text = raw[a:b].decode("utf-8", "replace")
            out.append(text[1:] if text.startswith(" ") else text)
        return out


def encoded(
    docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, check: bool = False
) -> DataFrame:
    """doc_id, ids: one row per row of ``docs``; with ``keep_text`` also text, with ``check`` also round_trip and markers.

    ``round_trip`` tells whether the ids decode to the text again, with literal markers as spaces; it is found where the text is encoded, so
    neither text nor ids go through a second worker. ``markers`` tells whether the text holds literal markers, which decode to spaces. Null and empty texts have no ids. A literal marker character counts as a space.
    Rows are independent of each other, so repeated rows and rows without an id are encoded as any other. Other columns are not
    read. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            texts = part.column("text")
            ids, counts = pieces.encode(texts)
            out = {
                "doc_id": part.column("doc_id"),
                "ids": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32())),
            }
            if keep_text:
                out["text"] = texts
            if check:
                given = pc.fill_null(texts, "")
                wanted = pc.replace_substring(given, MARK, " ")
                out["round_trip"] = pc.equal(pa.array(pieces.decode(ids, counts), pa.string()), wanted)
                out["markers"] = pc.match_substring(given, MARK)
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    more = ", text string" * keep_text + ", round_trip boolean, markers boolean" * check
    return source.mapInArrow(run, "doc_id long, ids array<int>" + more)


def decoded(coded: DataFrame, pieces: Pieces, keep: list[str]) -> DataFrame:
    """``keep`` and ``decoded`` for each row of ids; null ids are an empty text. Ids outside the model are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(batch.num_rows * words_module.SLICE_BYTES // max(batch.nbytes, 1)))
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                lists = part.column("ids")
                counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
                texts = pieces.decode(np.asarray(lists.flatten(), np.int64), counts)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(texts, pa.string())], names=[*keep, "decoded"])

    schema = coded.select(*keep).schema.add("decoded", "string")
    return coded.select(*dict.fromkeys([*keep, "ids"])).mapInArrow(run, schema)
