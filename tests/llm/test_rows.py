"""URL filter, mixing, language model, classifier, pieces, token files and the pipeline."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlake.llm import lm_score, mixing, pieces, quality, queries, token_files, url_filter

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, source string, score string, ids string, block string, size string"
ODD = [None, "", " \n\t", "one", "ONE one", "é x", "a" * 5000, "w " * 9000, "tab\there\x0bnow", "▁ mark", "<|endoftext|> x", "😀 漢字 \x00"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "x", "x", "x") for i, t, s in rows], SCHEMA)


def prose(n, seed, words=60):
    rnd = random.Random(seed)
    return [" ".join(f"{rnd.choice('The of in AND to'.split())} w{min(rnd.randrange(1, 90), rnd.randrange(1, 90))}" for _ in range(rnd.randrange(1, words))) for _ in range(n)]


def test_urls(spark):
    urls = {
        1: "http://a.net/x", 2: "https://EXAMPLE.net/en/1", 3: "http://www.example.com/de/?q", 4: "http://b.org/fr/x#t", 5: "http://xorg/fr/", 6: None,
        7: "no scheme", 8: "http://net", 9: "x://a.net?y=/z", 10: "http://u@h.com:80/p/q.html?b=1&a=2&b=3#f", 11: "http://example.net/en", 12: "://", 13: "http://a.org/a\nb",
        14: "http://a.b://c/d",
    }
    bad = {i: f"http://spam.biz/{'x/' * (i % 3)}p{i}.htm" for i in range(100, 160)} | {i: f"http://fine.biz/p{i}.htm" for i in range(160, 220)}
    long = {300: "http://spam.biz/" + "/".join("abc" for _ in range(3000)) + "?" + "&".join(f"k{i}=1" for i in range(500))}
    rows = [*urls.items(), *bad.items(), *long.items(), (1, urls[1]), (None, "http://spam.biz/")]
    pages = spark.createDataFrame([(i, u, "h", "t") for i, u in rows], "page_id long, url string, host string, tokens string")
    labels = spark.createDataFrame([(i, i < 160) for i in bad] + [(1, None), (None, True)], "id long, bad boolean")
    got = [r.asDict() for r in url_filter.judged(pages, labels, queries.URL_RULES).collect()]
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert {i: (by[i]["host"], by[i]["path"]) for i in urls} == {
        1: ("a.net", "/x"), 2: ("example.net", "/en/1"), 3: ("www.example.com", "/de/"), 4: ("b.org", "/fr/x"), 5: ("xorg", "/fr/"), 6: ("", ""), 7: ("", ""),
        8: ("net", ""), 9: ("a.net", ""), 10: ("u@h.com:80", "/p/q.html"), 11: ("example.net", "/en"), 12: ("", ""), 13: ("a.org", "/a\nb"), 14: ("a.b:", "//c/d"),
    }
    assert {i: by[i]["rule"] for i in urls} == {
        1: "net/", 2: "example.net/en/", 3: "example.com/de/", 4: "org/fr/", 11: "net/"} | dict.fromkeys((5, 6, 7, 8, 9, 10, 12, 13, 14))
    assert {i: by[i]["verdict"] for i in (1, 2, 3, 4, 6, 7, 11)} == {1: "block", 2: "allow", 3: "block", 4: "allow", 6: "allow", 7: "allow", 11: "block"}
    assert all(by[i]["verdict"] == ("block" if i < 160 else "allow") for i in bad)
    assert by[300]["verdict"] == by[None]["verdict"] == "block" and "spam" in by[300]["mined"]
    none = url_filter.judged(pages, labels.limit(0), queries.URL_RULES)
    assert none.where("rule is null and verdict <> 'allow'").count() == 0
    assert url_filter.judged(pages.limit(0), labels, queries.URL_RULES).count() == 0


def test_tokens_of_all_parts(spark):
    urls = {"http://m.Spam-Farm.a.example.com:80/x/Y/x/p.html?b=1&a=2&b=3#f": {
        "scheme=http", "label=m", "label=spam-farm", "label=a", "label=example", "label=com", "domain=example.com", "host=m.spam-farm.a.example.com:80", "segment=x",
        "segment=Y", "segment=p.html", "depth=4", "kind=html", "name=a", "name=b", "fragment=yes"}, "no scheme": set(), None: set(), "x://": {"scheme=x", "host=", "depth=0"}}
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", url_filter.tokens(F.col("url")).alias("t")).collect()
    assert {r.url: set(r.t) for r in rows} == urls and all(len(r.t) == len(set(r.t)) and r.t == sorted(r.t) for r in rows)


def test_mined_rules_are_those_of_plain_counting(spark):
    rnd = random.Random(8)
    pages = []
    for _ in range(400):
        have = {t for t in "abcdefg" if rnd.random() < 0.45}
        bad = {"a", "b"} <= have or "g" in have and rnd.random() < 0.8 or rnd.random() < 0.1
        pages.append((sorted(have), bad))
    found = url_filter.mine(spark.createDataFrame(pages, "tokens array<string>, bad boolean"), 0.05, 0.7, 10, 1.5).collect()
    real = [(set(t), b) for t, b in pages if t]
    base, rules = sum(b for _, b in real) / len(real), {}
    for size in range(1, 8):
        for items in itertools.combinations("abcdefg", size):
            fits = [b for t, b in real if t >= set(items)]
            hits = sum(fits)
            if hits >= max(10, 0.05 * len(real)) and hits / len(fits) >= max(0.7, 1.5 * base) and not any(set(r) < set(items) for r in rules):
                rules[items] = hits / len(fits)
    assert {tuple(r["items"]): pytest.approx(r.confidence) for r in found} == rules and ("a", "b") in rules and len(rules) > 1
    # Baskets of few tokens hold the most telling ones.
    few = url_filter.mine(spark.createDataFrame(pages, "tokens array<string>, bad boolean"), 0.05, 0.7, 10, 1.5, basket=1).collect()
    assert {tuple(r["items"]) for r in few} <= {("a",), ("b",), ("c",), ("d",), ("e",), ("f",), ("g",)}


def test_rules_of_pages_with_many_tokens_are_whole(spark, monkeypatch):
    rnd = random.Random(9)
    # Fourteen tokens are more telling by themselves than a and b, which tell a page as bad only together.
    pages = []
    for _ in range(400):
        have = set(rnd.choices(["ab", "a", "b", ""], [3, 8, 8, 1])[0])
        bad = have == {"a", "b"} or rnd.random() < 0.05
        pages.append((sorted(have | {f"t{i:02}" for i in range(14) if rnd.random() < (0.99 if bad else 0.25)}), bad))
    labelled = spark.createDataFrame(pages, "tokens array<string>, bad boolean")
    found = {tuple(r["items"]): r.confidence for r in url_filter.mine(labelled, 0.05, 0.8, 10, 1.5).collect()}
    fits = [b for t, b in pages if {"a", "b"} <= set(t)]
    assert found[("a", "b")] == pytest.approx(sum(fits) / len(fits))
    # By levels or at once, the rules are the same.
    few = labelled.select(F.filter("tokens", lambda t: (t < "t06")).alias("tokens"), "bad")
    whole = {tuple(r["items"]): pytest.approx(r.confidence) for r in url_filter.mine(few, 0.05, 0.6, 10, 1.2).collect()}
    monkeypatch.setattr(url_filter, "BASKET", 1)
    assert {tuple(r["items"]): r.confidence for r in url_filter.mine(few, 0.05, 0.6, 10, 1.2).collect()} == whole and len(whole) > 0


def test_rules_find_labels_inside_hosts_and_paths(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(600):
        label, mid = rnd.choice(["fine", "casino-win", "other"]), rnd.choice(["ads", "news", "blog"])
        url = f"https://{rnd.choice(['m', 'www', 'shop'])}.{label}.x{i % 40}.org/{mid}/p{i}.html"
        rows.append((i, url, label == "casino-win" or mid == "ads"))
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, _, b in rows if i % 3], "id long, bad boolean")
    got = {r.page_id: r for r in url_filter.judged(pages, labels, []).collect()}
    # Pages that were not labelled are judged as well as those that were.
    assert all((got[i].verdict == "block") == b for i, _, b in rows)
    assert {m for r in got.values() if r.mined for m in [r.mined]} <= {"label=casino-win", "segment=ads"}


def mix_rows():
    rnd = random.Random(3)
    rows = [(i, "w " * rnd.randrange(0, 40), rnd.choice(["big", "big", "big", "é", "a", None])) for i in range(400)]
    return rows + [(1000, "x " * 30, "tiny"), (1001, None, "blank"), (1002, "", "blank"), (7, "y y", "a"), (7, "y y", "a"), (None, "z z z", "a")]


def test_mixing(spark):
    rows = mix_rows()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    sql = queries.ORACLE["op3_mix_sources"].replace("ORDER BY size, doc_id)", "ORDER BY size, doc_id NULLS FIRST)")
    want = sorted(con.execute(sql).fetchall(), key=repr)
    counted = mixing.copies(frame(spark, rows)).withColumn("taken", F.col("copies") * F.col("size"))
    got = counted.select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, got), key=repr) == want
    assert sum({r.source: r.target for r in counted.collect()}.values()) == pytest.approx(1.5 * sum(r.size for r in got))
    assert all(r.taken <= 2 * r.size for r in got)
    for source in ("big", "é", "a", None):
        own = [r for r in counted.collect() if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
    out = mixing.mixed(frame(spark, rows))
    assert out.columns == frame(spark, []).columns
    assert Counter(r.doc_id for r in out.collect()) == +sum((Counter({r.doc_id: r.copies}) for r in counted.collect()), Counter())
    assert mixing.mixed(frame(spark, [])).count() == 0


@pytest.mark.parametrize("block_bytes", [1 << 20, 600])
@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model(spark, monkeypatch, order, block_bytes):
    rows = [(i, t, "s") for i, t in enumerate([*prose(50, 1, 25), *ODD])] + [(3, "the w1 w2", "s"), (None, "the w1 w2", "s"), (None, "the w1 w2", "s"), (5, "OF", "s"), (5, "OF", "s")]
    prior = 5.0
    # Small numbers of parts, stretches and repeats take all ways through the operator.
    monkeypatch.setattr(lm_score, "STRETCH", 7)
    monkeypatch.setattr(lm_score.Automaton.walk, "__defaults__", (7,))
    got = lm_score.scored(frame(spark, rows), F.col("doc_id") % 4 == 2, order=order, prior=prior, block_bytes=block_bytes, radix=3, many=2).collect()

    def tokens(t):
        return [w.encode().lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None]

    train = [tokens(t) for i, t, _ in rows if i is None or i % 4 != 2]
    grams, histories = Counter(), Counter()
    for w in train:
        full = ["<"] + w
        for i in range(1, len(full)):
            for k in range(1, order + 1):
                if i - k + 1 >= 0:
                    grams[tuple(full[i - k + 1 : i + 1])] += 1
                    histories[tuple(full[i - k + 1 : i])] += 1
    single = Counter(x for w in train for x in w)
    n, v = sum(single.values()), len(single)

    def p(full, i, k):
        if k == 1:
            return (single[full[i]] + 1) / (n + v + 1)
        h = tuple(full[i - k + 1 : i])
        return (grams[h + (full[i],)] + prior * p(full, i, k - 1)) / (histories[h] + prior)

    want = []
    for i, t, _ in rows:
        w = tokens(t)
        full = ["<"] + w
        base = sum(math.log10(p(full, j, 1)) for j in range(1, len(full)))
        score = sum(math.log10(p(full, j, min(order, j + 1))) for j in range(1, len(full)))
        want.append((i, i is not None and i % 4 == 2, len(w), sum(x in single for x in w), n, base, score))
    key = lambda r: (repr(r[0]), r[2], round(r[6], 6))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_language_model_without_training(spark):
    rows = [(1, "a b", "s"), (2, None, "s")]
    assert [r.score for r in lm_score.scored(frame(spark, rows), F.lit(True)).collect()] == [0.0, 0.0]
    assert lm_score.scored(frame(spark, []), F.lit(False)).count() == 0


def test_quality(spark):
    good = prose(120, 2)
    rnd = random.Random(1)
    junk = [" ".join(["spam!!"] * rnd.randrange(5, 60)) if i % 2 else " ".join(w.upper() + "$$$" for w in t.split()) for i, t in enumerate(prose(60, 5))]
    rows = [(i, t, "s") for i, t in enumerate([*good, *junk, *ODD])] + [(None, "x", "s"), (5, good[5], "s")]
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(180)] + [(0, 1), (0, None), (None, 0)], "id long, label int")
    got = quality.classified(frame(spark, rows), labels, F.col("doc_id") % 3 == 1).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 180]
    assert sum(r.predicted == (r.doc_id < 120) for r in held) >= 0.95 * len(held)
    again = quality.classified(frame(spark, rows), labels, F.col("doc_id") % 3 == 1).collect()
    assert sorted((repr(r.doc_id), round(r.score, 9)) for r in got) == sorted((repr(r.doc_id), round(r.score, 9)) for r in again)
    assert {r.score for r in quality.classified(frame(spark, rows), labels.limit(0), F.lit(False)).collect()} == {0.5}
    assert quality.classified(frame(spark, []), labels, F.lit(False)).count() == 0


def test_fit_is_that_of_plain_least_squares(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 2, (300, len(quality.STATISTICS)))
    y = (np.sin(x[:, 0]) + 0.3 * rng.normal(size=300) > 0).astype(float)
    rows = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y, strict=True)], "x array<double>, label int").repartition(5)
    model = quality.fit(rows, features=40, width=4.0, penalty=1e-3)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.deviation, x.std(0))
    z = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
    f = np.hstack([np.cos(z @ model.weights + model.shifts), z, np.ones((300, 1))])
    # Ridge as least squares with one more row per weight.
    root = math.sqrt(1e-3 * 300 / 10)
    want = np.linalg.lstsq(np.vstack([f, root * np.eye(f.shape[1])]), np.concatenate([y, np.zeros(f.shape[1])]), rcond=None)[0]
    assert np.allclose(model.ridge, want, atol=1e-6)
    # Isotonic levels by the formula of largest least means over the bins of raw scores.
    raw = np.clip(f @ want, -0.5, 1.5)
    bins = np.minimum(((raw + 0.5) / 2 * quality.BINS).astype(int), quality.BINS - 1)
    used = np.unique(bins)
    good, count = (np.array([v[bins == b].sum() for b in used]) for v in (y, np.ones(300)))
    level = [max(min(good[a : b + 1].sum() / count[a : b + 1].sum() for b in range(i, len(used))) for a in range(i + 1)) for i in range(len(used))]
    middle = [raw[bins == b].mean() for b in used]
    pools = sorted(set(level))
    at = [sum(m * c for m, c, v in zip(middle, count, level, strict=True) if v == p) / sum(c for c, v in zip(count, level, strict=True) if v == p) for p in pools]
    assert np.allclose(model.scores(x), np.clip(np.interp(raw, at, pools), 0, 1), atol=1e-6)


def test_features_stand_for_a_gaussian_kernel():
    rng = np.random.default_rng(1)
    d, n = len(quality.STATISTICS), 20_000
    model = quality.Model(np.zeros(d), np.ones(d), rng.normal(0, 1 / 4.0, (d, n)), rng.uniform(0, 2 * np.pi, n), np.zeros(n), np.zeros(1), np.zeros(1))
    a, b = rng.normal(0, 1, (2, 30, d))
    got = 2 / n * (model.features(a)[:, :n] * model.features(b)[:, :n]).sum(1)
    assert np.allclose(got, np.exp(-((a - b) ** 2).sum(1) / (2 * 4.0**2)), atol=0.04)


def test_pools():
    at, level = quality.pooled(np.arange(5.0), np.array([0, 3, 1, 0, 4]), np.array([4, 4, 4, 0, 4]))
    assert at.tolist() == [0.0, 1.5, 4.0] and level.tolist() == [0.0, 0.5, 1.0]


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))


def best_pieces(model, text):
    """Viterbi over all bytes of the whole text with a plain dictionary."""
    if not text:
        return []
    raw = (" " + text.replace("▁", " ")).encode()
    known = {model.texts[i]: i for i in model.value[model.value >= 0].tolist()}
    longest = max(map(len, known))
    best, came = {0: 0.0}, {}
    for i in range(len(raw)):
        if i not in best:
            continue
        size = 1 if raw[i] < 0x80 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
        options = [(e, [known[raw[i:e]]], model.scores[known[raw[i:e]]]) for e in range(i + 1, min(len(raw), i + longest) + 1) if raw[i:e] in known]
        if not any(e == i + size for e, _, _ in options):
            options.append((i + size, [int(model.byte_ids[b]) for b in raw[i : i + size]], model.unknown_score()))
        for e, ids, score in options:
            if best[i] + score > best.get(e, -math.inf):
                best[e], came[e] = best[i] + score, (i, ids)
    out, e = [], len(raw)
    while e:
        e, ids = came[e]
        out = ids + out
    return out


def test_pieces(spark, model):
    texts = [*ODD, *prose(30, 7), "  two  leading", "trailing  ", "new\nline \n", "mixed é漢 ñ ß ", "▁▁x▁"]
    got = queries.pieces.encoded(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]), model, keep_text=True, check=True)
    assert got.where("not round_trip").count() == 0
    ids = {r.doc_id: r.ids for r in got.collect()}
    assert ids == {i: best_pieces(model, t) for i, t in enumerate(texts)}
    back = {r.doc_id: r.decoded for r in pieces.decoded(got, model, ["doc_id"]).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in enumerate(texts)}
    assert pieces.decoded(pieces.encoded(frame(spark, []), model), model, ["doc_id"]).count() == 0
    broken = spark.createDataFrame([(1, [int(model.byte_ids[0xFF])]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in pieces.decoded(broken, model, ["doc_id"]).collect()} == {1: "\ufffd", 2: ""}


def test_round_trip_of_literal_markers(spark, tmp_path):
    docs = frame(spark, [(1, "a▁b", "s"), (2, "a b", "s"), (3, None, "s"), (4, "▁", "s")])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = {1: False, 2: True, 3: True, 4: False}
    assert {r.doc_id: r.round_trip for r in queries.op8_sentencepiece(spark, str(tmp_path)).collect()} == want
    assert {r.doc_id: r.round_trip for r in corpus_pipeline.to_pieces(spark, docs, "").collect()} == want


def test_pieces_are_those_of_the_library(model):
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    m = proto.ModelProto()
    m.ParseFromString(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    m.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    # The library's list of best segmentations comes from a full lattice; short texts keep its 32-bit sums exact.
    texts = [" ".join(t.split()[:6]) for t in prose(60, 9)] + ["the quick brown fox", "quick the"]
    ids, counts = model.encode(pa.array(texts))
    ends = np.cumsum(counts)
    assert [ids[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)] == [library.nbest_encode_as_ids(t, 2)[0] for t in texts]


def test_double_array():
    keys = sorted({bytes(random.Random(i).choices(b"abcxyz", k=1 + i % 5)) for i in range(200)})
    base, check, value = pieces.double_array(keys, list(range(len(keys))))

    def find(key):
        node = 0
        for b in key:
            child = base[node] + b
            if check[child] != node:
                return -1
            node = child
        return value[node]

    assert [find(k) for k in keys] == list(range(len(keys)))
    assert all(find(k) == -1 for k in (b"q", b"abcabcabc", b"\x00"))


@pytest.mark.parametrize("bits", [False, True])
def test_planes(bits):
    ids = np.random.default_rng(1).integers(0, 2**32, 1001).astype(np.uint32)
    planes = token_files.to_planes(ids, bits)
    assert len(planes) == (32 if bits else 4) and (token_files.from_planes(planes, len(ids)) == ids).all()


@pytest.mark.parametrize("bits", [False, True])
def test_token_files(spark, tmp_path, bits):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [*ODD, *prose(40, 4), "it's don't 'S x'll. A1b2. á. ..'s O'Neil's.", "<|ENDOFTEXT|> KK ß ½."]
    rows = [(i * 3 % 101, t, "s") for i, t in enumerate(texts)] + [(200, "same", "s"), (200, "same", "s"), (None, "none", "s")]
    chunks = token_files.encoded_chunks(frame(spark, rows), lambda: token_files.WordEncoder(path), 2, block=64, bits=bits)
    token_files.write(chunks, str(tmp_path / "ids"))
    stored = token_files.read(spark, str(tmp_path / "ids"))
    got = [tuple(r) for r in token_files.documents(stored).orderBy("start").collect()]
    tokenizer, want, at = Tokenizer.from_file(path), [], 0
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert stored.where("n_ids > 64").count() == 0
    empty = token_files.encoded_chunks(frame(spark, []), lambda: token_files.WordEncoder(path), 2)
    assert token_files.documents(empty).count() == 0


def test_exact_copies_of_repeated_and_missing_ids(spark):
    rows = [(3, "a", "s"), (5, "a", "s"), (5, "b", "s"), (None, "a", "s"), (None, "c", "s"), (None, "c", "s"), (None, "d", "s"),
            (6, "e", "s"), (6, "e", "t"), (7, None, "s"), (7, "", "s"), (None, None, "s")]
    left = corpus_pipeline.exact_copies(spark, frame(spark, rows), "")
    assert left.columns == frame(spark, rows).columns
    got = sorted(((r.doc_id, r.text or "") for r in left.collect()), key=repr)
    assert got == sorted([(3, "a"), (5, "b"), (None, "c"), (None, "d"), (6, "e"), (7, "")], key=repr)
    # Without a repeated id nothing but the copies goes.
    few = [(3, "a", "s"), (5, "a", "s"), (None, "a", "s"), (5, "b", "s")]
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.exact_copies(spark, frame(spark, few), "").collect()) == [(3, "a"), (5, "b")]


USED = ["_id", "_source", "_order", "_nth", "_size", "_copies", "_copy", "_text_sha256", "_gone_id", "_gone_sha", "_quality_score", "row", "sha", "key_1",
        "key_2", "copies", "size", "nth", "part", "gone_id", "label", "kept", "a.b"]


def test_stages_leave_columns_of_any_name_alone(spark, tmp_path):
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate([*prose(60, 12), *prose(60, 12)[:15]])] + [(None, f"no id {i % 5}", None) for i in range(40)]
    docs = frame(spark, rows).select("doc_id", "text", "source", *[F.lit(f"own {c}").alias(c) for c in USED])
    spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(60)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        left = corpus_pipeline.cut(out)
        assert left.count() > 0
        assert left.select(*[F.col(f"`{c}`") for c in USED]).distinct().collect() == [tuple(f"own {c}" for c in USED)]
    got = corpus_pipeline.exact_copies(spark, docs, str(tmp_path))
    assert got.where("doc_id is null").count() == 5 and got.where("doc_id is not null").count() == 60


@pytest.mark.parametrize("chunk", [3, 1000])
def test_mixing_of_rows_that_repeat_without_an_id(spark, monkeypatch, chunk):
    monkeypatch.setattr(mixing, "CHUNK", chunk)
    rows = [(None, "a b c", "s")] * 300 + [(None, f"d e{i % 7}", "s") for i in range(100)] + [(i, "f g", "t") for i in range(50)]
    docs = frame(spark, rows).repartition(3)
    taken = sum(r.copies * r.n for r in mixing.copies(docs).groupBy("copies").agg(F.count("*").alias("n")).collect())
    out = mixing.mixed(docs)
    assert out.count() == taken and out.where("text = 'a b c'").count() in range(300, 601)
    assert sorted(r.text for r in mixing.mixed(docs).collect()) == sorted(r.text for r in out.collect())


def test_pipeline(spark, tmp_path):
    rnd = random.Random(2)
    good = prose(80, 12)
    junk = [" ".join(["spam!!"] * rnd.randrange(5, 60)) for _ in range(40)]
    near = [" ".join([*prose(1, 40, 2), *(f"u{j}" for j in range(100)), f"v{i}"]) for i in range(5)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate([*good, *junk, *good[:20], *near])] + [(0, good[0], "s0"), (None, "of w3 w4 w5 in w9", None)]
    docs = frame(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 80)) for i in range(120)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    kept, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.cut(stage(spark, kept, str(tmp_path)))
        seen[name] = [r.doc_id for r in kept.collect()]
        assert name == "sentencepiece" or kept.columns == docs.columns
    assert not set(seen["quality"]) & set(range(80, 120)) and set(range(80)) <= set(seen["quality"])
    texts = {i: t for i, t, _ in rows}
    exact = [texts[i] for i in seen["exact_dedup"]]
    assert len(exact) == len(set(exact)) and len(seen["exact_dedup"]) == len(set(seen["exact_dedup"])) and 0 in seen["exact_dedup"]
    assert [i for i in seen["near_dedup"] if i is not None and i >= 140] == [140] and None in seen["near_dedup"]
    assert sorted(seen["mixing"], key=repr) == sorted(seen["sentencepiece"], key=repr)
    assert kept.where("not round_trip").count() == 0
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).where("doc_id is not null").collect()) == sorted(i for i in seen["mixing"] if i is not None)
