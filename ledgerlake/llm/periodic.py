"""Periodic runs of words, found over a Re-Pair grammar of each document.

Re-Pair (Larsson and Moffat, 1999) replaces repeated pairs of neighbours by new symbols until none is left; here pairs that are more frequent than
the pairs they overlap with go in the same round, for many documents side by side. A run lies across the boundary of one rule, the lowest whose
expansion holds all of it, or across a boundary between the symbols that remain. So the runs across each rule's boundary are computed once, within the
rule's first expansion, and are translated to all places where it is derived; maximal intervals merge what the rules see only in part.

Blocks of 1, 2, 4, ... words get numbers, equal blocks of a document the same one. A run of period q and four periods or more has equal blocks of l
words, l / 2 < q <= l, at distance q from a fixed grid around the boundary, and no equal block is nearer, as then a smaller period would do. So a
boundary has five places to look at per size, and equal blocks tell how far the period reaches on both sides. No hashes are involved.
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

from . import words as words_module
from .words import Words, slices

#: A run has at least so many words and periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(words_module)


def grouped(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``keys`` (below ``most``) in order of (key, place), and the number of each one's group of equal keys in that order."""
    n = len(keys)
    bits = n.bit_length()
    if int(most).bit_length() + bits <= 63:
        packed = np.sort((keys << bits) | np.arange(n))
        order, keys = packed & ((1 << bits) - 1), packed >> bits
    else:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
    new = np.ones(n, bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return order, np.cumsum(new) - 1


class Blocks:
    """Numbers of the blocks of 1, 2, 4, ... words that their document has more than once.

    ``names[k][i]`` numbers the block of 2^k words from i; -1 where it is met once or reaches beyond its document.
    ``next[k]`` has the places whose block occurs again, and the distance to its next occurrence.
    """

    def __init__(self, codes: np.ndarray, starts: np.ndarray):
        n, sizes = len(codes), np.diff(starts)
        self.ends = np.repeat(starts[1:], sizes)
        self.names, self.next = [], []
        kinds = int(codes.max(initial=0)) + 1
        places, keys, most = np.arange(n), codes + np.repeat(np.arange(len(sizes)), sizes) * kinds, len(sizes) * kinds
        while len(places):
            order, group = grouped(keys, most)
            same = group[1:] == group[:-1]
            repeated = np.zeros(len(order), bool)
            repeated[1:] |= same
            repeated[:-1] |= same
            order, at = places[order], np.flatnonzero(same)
            names = np.full(n, -1, np.int32)
            names[order[repeated]] = group[repeated]
            self.names.append(names)
            self.next.append((order[at], order[at + 1] - order[at]))
            size = 1 << (len(self.names) - 1)
            places = np.flatnonzero(names >= 0)
            places = places[places + 2 * size <= self.ends[places]]
            places = places[names[places + size] >= 0]
            most = int(group[-1]) + 1
            keys = names[places].astype(np.int64) * most + names[places + size]
            most *= most

    def _equal(self, k: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        name = self.names[k][i]
        return (name >= 0) & (name == self.names[k][j])

    def ahead(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """The number of equal words from places i < j on, before ``limit``."""
        j0 = j
        for k in range(len(self.names) - 1, -1, -1):
            fits = j + (1 << k) <= limit
            step = np.where(fits & self._equal(k, i, np.where(fits, j, 0)), 1 << k, 0)
            i, j = i + step, j + step
        return j - j0

    def behind(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """The number of equal words before places i < j, not before ``limit``."""
        i0 = i
        for k in range(len(self.names) - 1, -1, -1):
            size = 1 << k
            fits = i - size >= limit
            step = np.where(fits & self._equal(k, np.where(fits, i - size, 0), np.where(fits, j - size, 0)), size, 0)
            i, j = i - step, j - step
        return i0 - i


class Grammar:
    """Re-Pair grammars of documents side by side.

    Symbols below ``words`` are words, others rules; rule ``words + r`` derives ``left[r]`` and ``right[r]``, ``size[r]`` words in all, for the
    first time at word ``place[r]``. ``top`` and ``top_at`` have the symbols that remain and their first words.
    """

    def __init__(self, blocks: Blocks, starts: np.ndarray):
        n = len(blocks.ends)
        names = blocks.names[0] if n else np.empty(0, np.int32)
        # All words that are met once are one symbol, as no pair with them repeats.
        self.words = int(names.max(initial=-1)) + 2
        top, at = np.where(names >= 0, names, self.words - 1).astype(np.int64), np.arange(n)
        opens = np.zeros(n + 1, bool)
        opens[starts] = True
        live = np.zeros(n, bool)
        if len(blocks.names) > 1:
            live[blocks.names[1] >= 0] = True
        sizes, rounds, symbols = [np.ones(self.words, np.int64)], [], self.words
        self.steps = [self.words]
        size = sizes[0]
        while live.any():
            here = np.flatnonzero(live)
            order, group = grouped(top[here] * symbols + top[here + 1], symbols * symbols)
            counts = np.bincount(group)
            here, count = here[order], counts[group]
            again = count > 1
            live[here[~again]] = False
            here, group, count = here[again], group[again], count[again]
            if not len(here):
                break
            # A pair goes if none that overlaps it is more frequent; which of equally frequent ones comes first is dealt at random.
            bits = int(group[-1] + 1).bit_length()
            rank = np.zeros(len(top) + 1, np.int64)
            rank[here] = (count << bits) | ((group * 0x9E3779B1 + 0x7F4A7C15) & ((1 << bits) - 1))
            own = rank[here]
            goes = (own >= rank[here - 1]) & (own >= rank[here + 1])
            here, group = here[goes], group[goes]
            # In a stretch of one word over and over every other pair goes.
            follows = np.zeros(len(here), bool)
            follows[1:] = (here[1:] == here[:-1] + 1) & (group[1:] == group[:-1])
            nth = np.arange(len(here))
            nth -= np.maximum.accumulate(np.where(follows, 0, nth))
            here, group = here[nth % 2 == 0], group[nth % 2 == 0]
            new = np.ones(len(here), bool)
            new[1:] = group[1:] != group[:-1]
            first, symbol = here[new], symbols + np.cumsum(new) - 1
            left, right = top[first], top[first + 1]
            rounds.append((left, right, size[left] + size[right], at[first]))
            size = np.concatenate([size, rounds[-1][2]])
            symbols += len(first)
            self.steps.append(symbols)
            top[here] = symbol
            keep = np.ones(len(top), bool)
            keep[here + 1] = False
            moved = np.sort(here)
            moved -= np.arange(len(moved))
            top, at, live = top[keep], at[keep], live[keep]
            live[moved] = True
            live[moved[moved > 0] - 1] = True
            # No pair reaches into the next document.
            last = np.flatnonzero(opens[at[1:]]) if len(at) else np.empty(0, np.int64)
            live[last] = False
            live[-1] = False
        self.top, self.top_at = top, at
        self.left, self.right, self.size, self.place = (
            [np.concatenate(c) for c in zip(*rounds, strict=True)] if rounds else [np.empty(0, np.int64) for _ in range(4)]
        )
        self.opens = opens

    def boundaries(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Owner, place, and the words from ``low`` to ``high`` around it: of each rule (its number), and between the top symbols (-1)."""
        sizes = np.concatenate([np.ones(self.words, np.int64), self.size])
        inner = np.flatnonzero(~self.opens[self.top_at])
        place = self.top_at[inner]
        document = np.searchsorted(starts, place, "right") - 1
        low = np.concatenate([self.place, starts[document]])
        high = np.concatenate([self.place + self.size, ends[place]])
        owner = np.concatenate([np.arange(len(self.size)), np.full(len(place), -1)])
        return owner, np.concatenate([self.place + sizes[self.left], place]), low, high

    def derived(self, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rule, first word) of all derivations of rules below which, or in which, some rule is ``wanted``."""
        has = wanted.copy()
        for low, high in zip(self.steps[:-1], self.steps[1:], strict=True):
            rules = np.arange(low - self.words, high - self.words)
            for side in (self.left[rules], self.right[rules]):
                below = side >= self.words
                has[rules[below]] |= has[side[below] - self.words]
        sizes = np.concatenate([np.ones(self.words, np.int64), self.size])
        rule, at = self.top - self.words, self.top_at
        while len(rule):
            keep = rule >= 0
            keep[keep] = has[rule[keep]]
            rule, at = rule[keep], at[keep]
            yield rule, at
            left, right = self.left[rule], self.right[rule]
            rule, at = np.concatenate([left, right]) - self.words, np.concatenate([at, at + sizes[left]])


def _merged(q: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of a period that share a period's words are one; returned in order of (start, period)."""
    if not len(q):
        return q, s, e
    order = np.lexsort((s, q))
    q, s, e = q[order], s[order], e[order]
    step = np.cumsum(np.concatenate([[0], q[1:] != q[:-1]])) * (int(e.max()) + 1)
    reach = np.maximum.accumulate(e + step) - step
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (s[1:] > reach[:-1] - q[1:])
    first = np.flatnonzero(new)
    q, s, e = q[first], s[first], reach[np.append(first[1:], len(q)) - 1]
    order = np.lexsort((q, s))
    return q[order], s[order], e[order]


def runs(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Period, first word and end of all runs in documents whose word numbers follow each other, in order of (start, period)."""
    blocks = Blocks(codes, starts)
    grammar = Grammar(blocks, starts)
    owner, place, low, high = grammar.boundaries(starts, blocks.ends)
    found = []
    distance = np.zeros(len(codes), np.int64)
    for k, (at, d) in enumerate(blocks.next):
        size = 1 << k
        near = (d <= size) & (d > size // 2)
        at, d = at[near], d[near]
        if not len(at):
            continue
        distance[at] = d
        # Boundaries of documents without such blocks have nothing to look at.
        has = np.zeros(len(codes) + 1, bool)
        has[blocks.ends[at]] = True
        wide = np.flatnonzero((high - low >= max(LEAST_WORDS, LEAST_PERIODS * (size // 2 + 1))) & has[blocks.ends[np.minimum(low, len(codes) - 1)]])
        for t in range(5):
            i = place[wide] - t * max(1, size // 2)
            look = np.where(i >= low[wide], i, 0)
            q = distance[look]
            hit = (i >= low[wide]) & (q > 0) & (i + q + size <= high[wide])
            b, i, q = wide[hit], i[hit], q[hit]
            s = i - blocks.behind(i, i + q, low[b])
            e = i + q + blocks.ahead(i, i + q, high[b])
            good = (s < place[b]) & (e > place[b]) & (e - s >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q))
            found.append(np.stack([owner[b], q, s, e])[:, good])
        distance[at] = 0
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(3))
    owner, q, s, e = np.unique(np.concatenate(found, axis=1), axis=1)
    whole, n_rules = owner < 0, len(grammar.size)
    all_q, all_s, all_e = [q[whole]], [s[whole]], [e[whole]]
    owner, q, s, e = owner[~whole], q[~whole], s[~whole], e[~whole]
    counts = np.bincount(owner, minlength=n_rules)
    first = np.cumsum(counts) - counts
    for rule, at in grammar.derived(counts > 0):
        many = counts[rule]
        which = np.repeat(first[rule] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        shift = np.repeat(at - grammar.place[rule], many)
        all_q.append(q[which])
        all_s.append(s[which] + shift)
        all_e.append(e[which] + shift)
    return _merged(np.concatenate(all_q), np.concatenate(all_s), np.concatenate(all_e))


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Callable[[list[int | None], np.ndarray], np.ndarray] | None = None
) -> DataFrame:
    """doc_id, n_words, runs, text: one row per row of ``docs``.

    A run is a stretch of consecutive words with smallest period q, of six words and four periods or more, that no neighbouring word extends.
    ``runs`` has (start, length, period) of each in order of start, then period, words numbered from 0. ``text`` has the words, joined by single
    spaces, without those that any run contains after its first period. Words are compared as they are. Null and empty texts have no words
    and no runs. Rows that repeat an id are treated one by one, also those without. Other columns are not read.
    An empty table gives an empty result. ``rewrite`` takes the ids and the number of words of some documents and tells for each of their words
    which one stands in its place. A text is held whole by one task, at some 100 bytes a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"), lower=False)
            codes, starts = words.codes, words.starts
            if rewrite is not None:
                codes = codes[rewrite(batch.column("doc_id").to_pylist(), words.sizes())]
            q, s, e = runs(codes, starts)
            document = np.searchsorted(starts, s, "right") - 1
            change = np.zeros(len(codes) + 1, np.int64)
            np.add.at(change, s + q, 1)
            np.add.at(change, e, -1)
            kept = np.cumsum(change)[:-1] == 0
            text_ends = np.concatenate([[0], np.cumsum(kept)])[starts].astype(np.int32)
            texts = pa.ListArray.from_arrays(pa.array(text_ends), words.distinct.take(pa.array(codes[kept])))
            ends = np.searchsorted(document, np.arange(batch.num_rows + 1)).astype(np.int32)
            each = pa.StructArray.from_arrays([pa.array(s - starts[document]), pa.array(e - s), pa.array(q)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(words.sizes()), pa.ListArray.from_arrays(pa.array(ends), each), pc.binary_join(texts, " "),
            ], names=["doc_id", "n_words", "runs", "text"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, text string")
