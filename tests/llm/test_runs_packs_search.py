"""Periodic runs, packing and lexical search against plain computations."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerlake.llm import lexical, packing, periodic, queries, token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, source string, part string, ids string, n string, low string, term string, bag string, runs string"
ODD = [None, "", " \n\t", "one", "ONE one", "é x", "a" * 5000, "w " * 9000, "tab\there\x0bnow", "▁ mark", "<|endoftext|> x", "😀 漢字 \x00", "a-b_c's", "x b x b " * 40]


def frame(spark, rows, parts=1):
    return spark.createDataFrame([(i, t, s, *["x"] * 7) for i, t, s in rows], SCHEMA).repartition(parts)


def texts(n, seed):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        words = [f"w{min(rnd.randrange(1, 40), rnd.randrange(1, 40))}" for _ in range(rnd.randrange(0, 70))]
        if rnd.random() < 0.6:
            unit = [rnd.choice("abc") for _ in range(rnd.randrange(1, 9))]
            at = rnd.randrange(len(words) + 1)
            words[at:at] = (unit * rnd.randrange(2, 9))[: rnd.randrange(1, 60)]
        out.append(" ".join(words))
    return out


def plain_runs(words):
    """All maximal repetitions, period by period."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            run = words[i : j + q]
            if len(run) >= max(6, 4 * q) and not any(run[p:] == run[:-p] for p in range(1, q)):
                out.append((i, len(run), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    crc, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and crc % 10 == 0 and n:
        g = crc // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    digests = ["".join(f"{s},{size},{q}\n" for s, size, q in runs), " ".join(w for i, w in enumerate(words) if i not in gone)]
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, *[hashlib.sha256(d.encode()).hexdigest() for d in digests])


def test_runs_of_small_alphabets():
    rnd = random.Random(5)
    for _ in range(300):
        docs = [[rnd.randrange(rnd.choice([1, 2, 3])) for _ in range(rnd.randrange(0, 40))] * rnd.choice([1, 1, 4, 6]) for _ in range(3)]
        starts = np.cumsum([0, *map(len, docs)])
        q, s, e = periodic.runs(np.array([w for d in docs for w in d], np.int64), starts)
        got = [[(int(b - low), int(c - b), int(a)) for a, b, c in zip(q, s, e, strict=True) if low <= b < high] for low, high in zip(starts, starts[1:])]
        assert got == [plain_runs(d) for d in docs]


def test_grammar_derives_its_texts():
    words = np.array([1, 2, 3, 1, 2, 3, 1, 2, 3, 4, 4, 4, 4, 4, 1, 2, 5, 1, 2, 1, 2], np.int64)
    starts = np.array([0, 17, 17, 21])
    blocks = periodic.Blocks(words, starts)
    grammar = periodic.Grammar(blocks, starts)

    def derive(symbol, at):
        if symbol < grammar.words:
            return words[at : at + 1].tolist()
        left, right = grammar.left[symbol - grammar.words], grammar.right[symbol - grammar.words]
        first = derive(left, at)
        return first + derive(right, at + len(first))

    assert [w for x, at in zip(grammar.top, grammar.top_at, strict=True) for w in derive(x, at)] == words.tolist()
    pairs = Counter((a, b) for a, b in zip(grammar.top, grammar.top[1:], strict=False))
    assert len(grammar.top) < 12 and pairs[(grammar.top[0], grammar.top[1])] == 1


def test_periodic_runs(spark, tmp_path):
    rows = [(i, t, "s") for i, t in enumerate([*ODD, *texts(150, 3)])] + [(7, "w w w w w w w", "s"), (None, "q r q r q r q r q", "s"), (7, "w w w w w w w", "s")]
    frame(spark, rows, 3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.op11_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((plain_row(i, t) for i, t, _ in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 40
    found = {r.doc_id: r for r in periodic.periodic_runs(frame(spark, rows)).collect()}
    assert found[None].text == "q r" and found[None].runs[0].asDict() == {"start": 0, "length": 9, "period": 2} and found[0].text == ""
    assert periodic.periodic_runs(frame(spark, [])).count() == 0


def pack_rows():
    rnd = random.Random(4)
    rows = [(i, t, rnd.choice(["big", "big", "big", "mid", "é", None])) for i, t in enumerate([*ODD, *texts(200, 9)])]
    return rows + [(900 + i, "x y", f"tiny{i}") for i in range(30)] + [(3, "again", "mid"), (3, "again", "mid"), (None, "none", "tiny0")]


@pytest.mark.parametrize(("window", "parts", "sent"), [(4096, 3, 100_000), (64, 5, 0), (7, 1, 100_000)])
def test_packing(spark, monkeypatch, window, parts, sent):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "BROADCAST_ROWS", sent)
    path = public_tokenizers.path("word_bpe_49k.json")
    rows, tokenizer = pack_rows(), Tokenizer.from_file(path)
    got = packing.packed(frame(spark, rows, parts), lambda: token_files.WordEncoder(path), 2, window).collect()
    want = [(i, s, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, s in rows]
    total = sum(len(ids) for _, _, ids in want)
    by_window, by_doc = defaultdict(list), defaultdict(Counter)
    for r in got:
        assert len(r.ids) == 4 * r.length and r.length > 0
        by_window[r.sequence_id].append(r)
        by_doc[r.doc_id, r.source][r.start, r.doc_tokens, bytes(r.ids)] += 1
    # Windows are filled without gaps, all but the last to the end.
    assert sorted(by_window) == list(range(-(-total // window)))
    for w, pieces in by_window.items():
        ends = sorted((r.offset, r.offset + r.length) for r in pieces)
        assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
        assert ends[-1][1] == (window if (w + 1) * window <= total else total - w * window)
    # Each id is in one piece.
    copies = Counter((i, s, tuple(ids)) for i, s, ids in want)
    for (doc_id, source, ids), n in copies.items():
        at = 0
        own = by_doc[doc_id, source]
        if n == 1 and sum((i, s) == (doc_id, source) for i, s, _ in want) == 1:
            for (start, size, raw), m in sorted(own.items()):
                assert (start, size, m) == (at, len(ids), 1)
                assert np.frombuffer(raw, "<u4").tolist() == list(ids[at : at + len(raw) // 4])
                at += len(raw) // 4
            assert at == len(ids)
    assert sum(r.length for r in got) == total
    # Proportions of queues hold in every full window.
    sums = Counter()
    for _, s, ids in want:
        sums[s] += len(ids)
    for s, n in sums.items():
        if n * window >= total and (s == "big" or sum(m for m in sums.values() if m * window < total) * window >= total):
            shares = [sum(r.length for r in by_window[w] if r.source == s) for w in range(total // window)]
            assert all(abs(x - window * n / total) <= 2 for x in shares)
    assert packing.packed(frame(spark, []), lambda: token_files.WordEncoder(path), 2).count() == 0


def test_share_is_exact():
    rnd = random.Random(1)
    for total in (1, 7, 10**6 + 3, 2**50):
        p, c = ([rnd.randrange(total + 1) for _ in range(2000)] + [0, total, total] for _ in range(2))
        assert packing.share(np.array(p), np.array(c), total).tolist() == [a * b // total for a, b in zip(p, c, strict=True)]


def plain_search(rows, items, k):
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    docs = [(i, Counter(terms(t))) for i, t, _ in rows]
    n_docs, length = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out, asked = [], defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    for item, wanted in asked.items():
        scored = []
        for i, c in docs:
            m = 10 + 90 * sum(c.values()) * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_terms", [10, 1000])
@pytest.mark.parametrize("cells", [64, 1 << 20])
def test_lexical_search(spark, monkeypatch, block_terms, cells):
    monkeypatch.setattr(lexical, "_CELLS", cells)
    same = [(500 + i, "w1 W2, zebra", "s") for i in range(40)]
    rows = [(i, t, "s") for i, t in enumerate([*ODD, *texts(120, 6)])] + same + [(501, "w1 w2 zebra", "s"), (None, "zebra w1 w2", "s"), (None, "rare", "s")]
    random.Random(2).shuffle(rows)
    items = [(1, "W1 zebra zebra"), (2, "nothing here"), (3, None), (4, "w3 w4 w5 a b c 漢字 É"), (5, "rare"), (1, "w7"), (None, "w9 one"), (6, " ".join(f"w{i}" for i in range(40)))]
    table = spark.createDataFrame([(i, t, 0, 0) for i, t in items], "item_id long, text string, score int, rank int")
    got = lexical.search(frame(spark, rows, 3), table, block_terms=block_terms).collect()
    assert sorted(map(tuple, got), key=repr) == plain_search(rows, items, 10)
    assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"]) if r.item_id == 1][:3] == [500, 501, 501]
    assert lexical.search(frame(spark, []), table).count() == lexical.search(frame(spark, rows), table.limit(0)).count() == 0
