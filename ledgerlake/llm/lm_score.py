"""Language-model scores by a weighted backoff automaton over word n-grams.

The states of the automaton are the n-grams seen in training; an arc carries the smoothed log-probability of the next word, and
a failure arc leads from a history to the one without its first word at the cost of its backoff weight (Allauzen, Mohri and Roark,
2003). Smoothing is by a Dirichlet prior: P(w | h) = (c(hw) + m P(w | h')) / (c(h) + m), so a failure arc of h weighs
m / (c(h) + m); below the bigrams lies the add-one model of single tokens. All probabilities of a history sum to one.

The model grows with the corpus, so nobody holds all of it. Documents are dealt into blocks of bounded text. A block sends the
sorted keys of the n-grams that occur in it, with its training counts, towards the tasks that own ranges of keys; the counts of the whole corpus
come back the same way. With many blocks the way has several hops: at each, some blocks merge the keys they have in common and part them by
the next digit of the key, so a block or task sends at most ``RADIX`` rows per hop, and rows grow with the corpus times the logarithm of its size.
From the answers a block builds the part of the automaton that its texts can reach and runs them through it. Keys travel as compressed
differences.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import words as words_module
from .words import Words, joined, mix, trim

#: Text of a block; a task holds about twenty times as much while it works on one.
BLOCK_BYTES = 6 << 20
ORDER, PRIOR = 2, 300.0
#: Parts that keys are sent in from one place at a time.
RADIX = 256
#: Repeats of a row from which on it is read once with its number of repeats.
MANY = 1_000
#: Tokens that the automaton reads in one go; texts of more are read in parts, each from the state that the words before it lead to.
STRETCH = 256
_END, _BEGIN = np.uint64(0x8F1BBCDCCA62C1D6), np.uint64(0x5A8279996ED9EBA2)
_ONE = np.uint64(1)

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(words_module)


class Grams:
    """The n-grams of a block of texts, as keys in one sorted list.

    ``at[k]`` has for each token the place of the key of its n-gram of k + 1 words, -1 where its text has not so many. A text ends
    in an end token and its first history is the begin mark. Keys of single tokens are odd, all others even.
    """

    def __init__(self, texts: pa.Array, order: int):
        words = Words(texts)
        self.sizes = words.sizes() + 1
        ends = np.cumsum(self.sizes)
        self.first = ends - self.sizes
        tokens = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
        is_end = np.zeros(len(tokens), bool)
        is_end[ends - 1] = True
        tokens[is_end] = _END
        if len(words.codes):
            tokens[~is_end] = mix(words.hashes())[words.codes]
        place = np.arange(len(tokens)) - np.repeat(self.first, self.sizes)
        keys, valid = [tokens | _ONE], [np.ones(len(tokens), bool)]
        history = np.where(place > 0, np.roll(tokens, 1), _BEGIN)
        for k in range(1, order):
            ok = place >= k - 1
            keys.append(joined(history, tokens) & ~_ONE)
            valid.append(ok)
            history = np.roll(keys[-1], 1)
        self.begin = np.array([_BEGIN & ~_ONE])
        self.keys, inverse = np.unique(np.concatenate([self.begin, *[k[v] for k, v in zip(keys, valid, strict=True)]]), return_inverse=True)
        self.begin_at, cuts = int(inverse[0]), np.cumsum([1, *[int(v.sum()) for v in valid]])
        self.at = []
        for v, low, high in zip(valid, cuts[:-1], cuts[1:], strict=True):
            at = np.full(len(tokens), -1, np.int64)
            at[v] = inverse[low:high]
            self.at.append(at)

    def counts(self, weights: np.ndarray) -> np.ndarray:
        """How often each key occurs when each text counts ``weights`` times; the begin mark counts texts."""
        rows = np.repeat(weights, self.sizes)
        out = np.zeros(len(self.keys), np.int64)
        for at in self.at:
            used = (at >= 0) & (rows > 0)
            # Sums below 2^53 are exact in doubles.
            out += np.bincount(at[used], rows[used], len(out)).astype(np.int64)
        out[self.begin_at] += int(weights.sum())
        return out

    def histories(self, k: int) -> np.ndarray:
        """Per token the place of the key of the k words before it; -1 where its text has not so many."""
        before = np.roll(self.at[k - 1], 1)
        if len(before):
            before[self.first] = self.begin_at if k == 1 else -1
        return before


class Automaton:
    """The states and arcs that the texts of a block can reach.

    State 0 is the empty history and has an arc for every token of the block; the others are the histories seen in training. ``arcs`` lists
    (state, token) in order as one number each, ``weight`` and ``target`` what an arc costs and leads to; ``fail`` and ``fail_weight``
    lead from a state to that of its history without the first word.
    """

    def __init__(self, grams: Grams, counts: np.ndarray, tokens: int, distinct: int, prior: float):
        self.grams, n, order = grams, len(counts), len(grams.at)
        self.kinds = n
        single = grams.keys % np.uint64(2) == 1
        value, follows = np.zeros(n), np.zeros(n, np.int64)
        value[single] = np.log10((counts[single] + 1.0) / (tokens + distinct + 1.0))
        end_at = int(np.searchsorted(grams.keys, _END | _ONE))
        state = np.zeros(n, np.int64)
        seen, shorter_of, listed = [], [], []
        begins = counts[grams.begin_at] > 0 and order > 1
        if begins:
            seen.append(np.array([grams.begin_at]))
            shorter_of.append(np.array([-1]))
        for k in range(order):
            at = grams.at[k]
            ok = np.flatnonzero(at >= 0)
            here, one = np.unique(at[ok], return_index=True)
            one = ok[one]
            listed.append((here, one))
            if k + 1 < order:
                good = (counts[here] > 0) & (grams.at[0][one] != end_at)
                seen.append(here[good])
                shorter_of.append(grams.at[k - 1][one[good]] if k else np.full(int(good.sum()), -1))
        states = np.concatenate(seen) if seen else np.empty(0, np.int64)
        state[states] = np.arange(1, len(states) + 1)
        self.begin = int(state[grams.begin_at]) if begins else 0
        # Where a token leads: the longest of its histories that is a state.
        rows, weights, targets = [], [], []
        for k, (here, one) in enumerate(listed):
            shorter = grams.at[k - 1][one] if k else None
            follows[here] = np.where(state[here] > 0, state[here], follows[shorter] if k else 0)
            if k:
                history = grams.histories(k)[one]
                lower = 10.0 ** value[shorter]
                value[here] = np.log10((counts[here] + prior * lower) / (counts[history] + prior))
                real = counts[here] > 0
                here, history, one = here[real], history[real], one[real]
                rows.append(state[history] * n + grams.at[0][one])
            else:
                rows.append(here)
            weights.append(value[here])
            targets.append(follows[here])
        arcs = np.concatenate(rows)
        order_ = np.argsort(arcs)
        self.arcs, self.weight, self.target = arcs[order_], np.concatenate(weights)[order_], np.concatenate(targets)[order_]
        above = np.concatenate(shorter_of) if shorter_of else np.empty(0, np.int64)
        self.fail = np.concatenate([[0], np.where(above >= 0, state[np.maximum(above, 0)], 0)])
        self.fail_weight = np.concatenate([[0.0], np.log10(prior / (counts[states] + prior))])
        self.base, self.counts = value, counts

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read one token in each of some states: what it costs, and the states it leads to."""
        cost, target, open_ = np.zeros(len(state)), np.zeros(len(state), np.int64), np.arange(len(state))
        while len(open_):
            wanted = state[open_] * self.kinds + token[open_]
            at = np.minimum(np.searchsorted(self.arcs, wanted), len(self.arcs) - 1)
            found = self.arcs[at] == wanted
            hit, at = open_[found], at[found]
            cost[hit] += self.weight[at]
            target[hit] = self.target[at]
            open_ = open_[~found]
            cost[open_] += self.fail_weight[state[open_]]
            state = state.copy()
            state[open_] = self.fail[state[open_]]
        return cost, target

    def walk(self, stretch: int = STRETCH) -> np.ndarray:
        """The log-probability of each token: all stretches of all texts are read from left to right, side by side."""
        grams, token = self.grams, self.grams.at[0]
        score = np.zeros(len(token))
        parts = -(-grams.sizes // stretch)
        nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        first = np.repeat(grams.first, parts) + nth * stretch
        length = np.minimum(np.repeat(grams.sizes, parts) - nth * stretch, stretch)
        by_length = np.argsort(-length, kind="stable")
        nth, first, length = nth[by_length], first[by_length], length[by_length]
        # A later stretch starts in the state that the words before it lead to from the empty history.
        state, later = np.where(nth == 0, self.begin, 0), np.flatnonzero(nth)
        for back in range(len(grams.at) - 1, 0, -1):
            ready = later[nth[later] * stretch >= back]
            state[ready] = self.step(state[ready], token[first[ready] - back])[1]
        for i in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-length, -i, "left"))
            at = first[:n] + i
            score[at], state[:n] = self.step(state[:n], token[at])
        return score


def _packed(values: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _differences(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def _merged(keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The keys of several senders, each once, with the sums of their counts; and where each sender's keys are among them."""
    sets = [np.cumsum(_unpacked(k), dtype=np.uint64) for k in keys]
    merged, at = np.unique(np.concatenate(sets), return_inverse=True)
    sums = np.bincount(at, np.concatenate([_unpacked(c) for c in counts]).astype(np.float64), len(merged)).astype(np.int64)
    return merged, sums, np.split(at, np.cumsum([len(x) for x in sets])[:-1])


def _table(rows: list[tuple], columns: dict[str, pa.DataType]) -> pa.Table:
    arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), columns.values(), strict=True)] if rows else [pa.array([], t) for t in columns.values()]
    return pa.Table.from_arrays(arrays, names=list(columns))


_ASK = {"node": pa.int64(), "sender": pa.int64(), "slot": pa.int32(), "keys": pa.binary(), "counts": pa.binary()}
_REPLY = {"node": pa.int64(), "slot": pa.int32(), "counts": pa.binary(), "tokens": pa.int64(), "distinct": pa.int64()}
_ASK_SCHEMA = "node long, sender long, slot int, keys binary, counts binary"
_REPLY_SCHEMA = "node long, slot int, counts binary, tokens long, distinct long"


def _sent(sender: int, level: int, radix: int, keys: np.ndarray, counts: np.ndarray) -> pa.Table:
    """What a place sends on: its keys, parted by one more digit.

    A place of ``level`` stands for radix^level blocks and the keys that begin with some ``level`` digits, both of which its number tells.
    """
    span = radix**level
    group, prefix = divmod(sender, span)
    low = prefix * radix
    limits = np.array([((low + i) << 64) // (span * radix) for i in range(1, radix)], np.uint64)
    cuts = [0, *np.searchsorted(keys, limits), len(keys)]
    rows = []
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if a < b:
            rows.append((group // radix * span * radix + low + i, sender, i, _packed(_differences(keys[a:b])), _packed(counts[a:b])))
    return _table(rows, _ASK)


def _replied(asks: pa.Table, total_of: Callable[[np.ndarray, np.ndarray], np.ndarray], whole: bool) -> pa.Table:
    """The total counts of what each sender asked for; ``whole`` adds up tokens and distinct ones, where all of their counts are known."""
    keys, sums, places = _merged(asks.column("keys").to_pylist(), asks.column("counts").to_pylist())
    total = total_of(keys, sums)
    single = total[keys % np.uint64(2) == 1] if whole else total[:0]
    rows = [
        (sender, slot, _packed(total[at]), 0, 0)
        for sender, slot, at in zip(asks.column("sender").to_pylist(), asks.column("slot").to_pylist(), places, strict=True)
    ]
    rows[0] = (*rows[0][:3], int(single.sum()), int((single > 0).sum()))
    return _table(rows, _REPLY)


def _answers(replies: pa.Table) -> np.ndarray:
    """The counts of all of a place's keys from the replies to its parts."""
    parts = sorted(zip(replies.column("slot").to_pylist(), replies.column("counts").to_pylist(), strict=True))
    return np.concatenate([_unpacked(c) for _, c in parts]).astype(np.int64)


def _weighed(rows: DataFrame, many: int) -> DataFrame:
    """The rows with ``times``: rows that repeat very often are one row, the others are left as they are, with 1."""
    same = F.xxhash64("doc_id", "text", "held_out")
    often = cut(rows.groupBy(same.alias("same")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= many).select("same"))
    if often.isEmpty():
        return rows.withColumn("times", F.lit(1).cast("long"))
    # Copies shrink per task, so the shuffle has one row of them from each.
    known = rows.withColumn("same", same)
    once = known.groupBy("same", "doc_id", "text", "held_out").agg(F.count(F.lit(1)).alias("times"))
    apart = once.join(often.withColumn("often", F.lit(True)), "same", "left")
    times = F.when(F.col("often"), F.array("times")).otherwise(F.array_repeat(F.lit(1).cast("long"), F.col("times").cast("int")))
    return apart.select("doc_id", "text", "held_out", F.explode(times).alias("times"))


def scored(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
    order: int = ORDER, prior: float = PRIOR, block_bytes: int = BLOCK_BYTES, radix: int = RADIX, many: int = MANY,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``.

    The model learns from the rows where ``held_out`` is not true. Words are lower-cased in A-Z; each text ends in one end token, so a
    null or empty text has that token alone. ``n_known`` counts tokens seen in training, ``train_tokens`` all of training.
    ``base_score`` adds up log10((c + 1) / (N + V + 1)) of single tokens, ``score`` is the model's log10 probability of the text.
    Every row counts, repeated ones and those without an id too. Other columns are not read. Without
    training rows each text scores 0. An empty table gives an empty result.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // block_bytes) + 1
    rows = _weighed(rows, many)
    rows = rows.withColumn("node", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("long"))
    hops = 1
    while radix**hops < blocks:
        hops += 1
    # The smallest number of parts that reaches all blocks in so many hops.
    parts = max(2, round(blocks ** (1 / hops)) - 1)
    while parts**hops < blocks:
        parts += 1

    def asked(table: pa.Table) -> pa.Table:
        trim()
        grams = Grams(table.column("text").combine_chunks(), order)
        weights = np.where(np.asarray(table.column("held_out").combine_chunks()), 0, np.asarray(table.column("times").combine_chunks()))
        return _sent(table.column("node")[0].as_py(), 0, parts, grams.keys, grams.counts(weights))

    def passed_on(level: int) -> Callable[[pa.Table], pa.Table]:
        def run(asks: pa.Table) -> pa.Table:
            trim()
            keys, sums, _ = _merged(asks.column("keys").to_pylist(), asks.column("counts").to_pylist())
            return _sent(asks.column("node")[0].as_py(), level, parts, keys, sums)

        return run

    def answered(asks: pa.Table) -> pa.Table:
        trim()
        return _replied(asks, lambda keys, sums: sums, True)

    def handed_back(asks: pa.Table, replies: pa.Table) -> pa.Table:
        trim()
        return _replied(asks, lambda keys, sums: _answers(replies), False)

    asks = [rows.groupBy("node").applyInArrow(asked, _ASK_SCHEMA)]
    for level in range(1, hops):
        asks[-1] = cut(asks[-1])
        asks.append(asks[-1].groupBy("node").applyInArrow(passed_on(level), _ASK_SCHEMA))
    replies = cut(asks[-1].groupBy("node").applyInArrow(answered, _REPLY_SCHEMA))
    whole = replies.agg(F.sum("tokens"), F.sum("distinct")).first()
    tokens, distinct = int(whole[0] or 0), int(whole[1] or 0)
    for level in range(hops - 2, -1, -1):
        replies = cut(asks[level].groupBy("node").cogroup(replies.groupBy("node")).applyInArrow(handed_back, _REPLY_SCHEMA))

    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        trim()
        grams = Grams(texts.column("text").combine_chunks(), order)
        counts = _answers(replies)
        automaton = Automaton(grams, counts, tokens, distinct, prior)
        single = grams.at[0]
        sums = [np.add.reduceat(v, grams.first) for v in (counts[single] > 0, automaton.base[single], automaton.walk())]
        return pa.Table.from_arrays([
            texts.column("doc_id").combine_chunks(), texts.column("held_out").combine_chunks(), pa.array(grams.sizes.astype(np.int64)),
            pa.array(sums[0].astype(np.int64)), pa.array([tokens] * len(grams.sizes), pa.int64()), pa.array(sums[1]), pa.array(sums[2]),
            texts.column("times").combine_chunks(),
        ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "times"])

    given = replies.select("node", "slot", "counts").groupBy("node")
    columns = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = rows.groupBy("node").cogroup(given).applyInArrow(run, columns + ", times long")
    return out.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times", "_nth")
