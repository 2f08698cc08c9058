"""Near-dedup, exact dedup, line dedup and top-k against plain loops."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import exact_dedup, line_dedup, near_dedup, queries, top_k, words

SCHEMA = "doc_id long, text string, kept string, key string, n_shingles string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with those the operators use."""
    return spark.createDataFrame([(i, t, "x", "y", None) for i, t in rows], SCHEMA)


def shingles(text, size):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    w = [x for x in w if x]
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def components(rows, size, per_cent):
    sets = [(i, shingles(t, size)) for i, t in rows]
    label = {i: i for i, _ in rows}
    links = [
        (i, j) for n, (i, a) in enumerate(sets) for j, b in sets[:n]
        if a and b and i is not None and j is not None and 100 * len(a & b) >= per_cent * len(a | b)
    ]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return label


def family(n, length, changes, pool, seed):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(500)}" for _ in range(length)]
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randrange(changes)):
            w[rnd.randrange(length)] = f"x{rnd.randrange(pool)}"
        yield " ".join(w)


def test_near_duplicates_of_mutated_copies(spark):
    texts = [*family(90, 150, 9, 30, 1), *family(60, 40, 4, 10**6, 2), *["Same  text\tHERE now"] * 40, "same text here now", *family(20, 8, 2, 3, 3)]
    rows = list(enumerate(texts))
    random.Random(4).shuffle(rows)
    want = components(rows, 3, 85)
    got = near_dedup.near_duplicates(frame(spark, rows), size=3, per_cent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingles(t, 3)) for i, t in rows}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "ONE"), (6, "one two"), (7, long), (8, long + " end"),
            (9, "É x"), (10, "é x"), (11, "a b c d"), (11, "e f g h"), (12, "a b c d"), (13, "e f g h"), (11, "a b c d")]
    got = near_dedup.near_duplicates(frame(spark, [*rows, (None, "one")]), size=3, per_cent=85).collect()
    assert len(got) == 16
    label = {r.doc_id: r.component_id for r in got}
    # The two texts of id 11 make one node; E with an accent is no A-Z.
    assert label == {None: None, 1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, 9: 9, 10: 10, 11: 11, 12: 11, 13: 11}
    assert [r.kept for r in got if r.doc_id is None] == [True]
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_near_duplicates_of_repeated_rows(spark):
    """A family that the first star leaves open, with each row given twice."""
    rows = list(enumerate(family(90, 150, 9, 30, 1)))
    got = near_dedup.near_duplicates(frame(spark, rows * 2), size=3, per_cent=85).collect()
    assert len(got) == 180 and {r.doc_id: r.component_id for r in got} == components(rows, 3, 85)


def test_default_similarity(spark):
    rows = list(enumerate(family(60, 60, 5, 50, 8)))
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == components(rows, 5, 80)


def test_signature_of_equal_sets_is_equal_and_full():
    s = np.unique(np.random.default_rng(1).integers(0, 2**63, 7).astype(np.uint64))
    a = near_dedup.densified(s, 125)
    assert set(a.tolist()) <= set(s.tolist()) and (a == near_dedup.densified(s.copy(), 125)).all()


def exact(rows, keep):
    best = max if keep == "max" else min
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return sorted(((i, best(x for x in groups[t or ""] if x is not None), len(groups[t or ""])) for i, t in rows), key=repr)


@pytest.mark.parametrize("digest", [exact_dedup.content_hash, lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(3))])
@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_duplicates_and_colliding_hashes(spark, keep, digest):
    rows = [(i, random.Random(i).choice([None, "", "a", "A", "b " * 5000, "é", "c"])) for i in range(120)] + [(500, "only"), (500, "only"), (None, "a")]
    got = exact_dedup.exact_duplicates(frame(spark, rows), keep=keep, digest=digest).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=repr) == exact(rows, keep)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert exact_dedup.exact_duplicates(frame(spark, []), keep=keep, digest=digest).count() == 0


def lines_rows():
    rnd = random.Random(5)
    stock = [f"line {i} " + "word " * (60 if i % 7 == 0 else 3) for i in range(25)] + ["", "  "]
    rows = [(i, "\n".join(rnd.choice(stock) for _ in range(rnd.randrange(1, 14)))) for i in range(80)]
    return rows + [(100, None), (101, ""), (102, "\n\n"), (103, "a\na\na\na\na"), (104, "x\r\ny"), (105, rows[3][1]), (106, "q " * 20_000)]


def test_line_dedup(spark):
    rows = lines_rows()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = sorted(con.execute(queries.ORACLE["op10_line_dedup"]).fetchall())
    got = sorted((r.doc_id, r.n_lines, r.n_deleted, r.text) for r in line_dedup.without_repeats(frame(spark, rows)).collect())
    assert got == want and any(n for _, _, n, _ in got)


def test_line_dedup_of_repeated_rows(spark):
    rows = [(1, "a\nb\nc\nd"), (1, "a\nb\nc\nd"), (1, "z\na\nb\nc"), (2, "b\nc\nd"), (None, "p\nq\nr"), (3, "p\nq\nr")]
    got = line_dedup.without_repeats(frame(spark, rows)).collect()
    assert len(got) == 6 and sum(r.doc_id is None for r in got) == 1
    assert {r.text for r in got if r.doc_id in (2, 3)} == {""} and [r.text for r in got if r.doc_id is None] == ["p\nq\nr"]
    same = [r.text for r in got if r.doc_id == 1]
    assert sorted(same) in (["a\nb\nc\nd", "a\nb\nc\nd", "z"], ["d", "d", "z\na\nb\nc"])
    assert line_dedup.without_repeats(frame(spark, [])).count() == 0


def test_line_dedup_of_passages(spark):
    def words(tag, n):
        return " ".join(f"{tag}{i}" for i in range(n))

    two, long = f"{words('a', 30)}\n{words('b', 25)}", words("c", 60)
    rows = [
        (1, f"start\n{two}\nend one"), (2, f"{words('a', 30)}\n\n{words('b', 25)}\nother"), (3, f"{long}\nshort line"), (4, f"x\nshort line\n{long}"),
        (5, f"{words('a', 30)}\nalone"), (6, f"{words('b', 25)}\n{words('a', 30)}"), (7, "p q\nr s\nt u"), (8, "zero\np q\nr s\nt u\nv"), (9, "p q\nr s"),
        *[(20 + i, f"own {i}\nshort line\nmine {i}") for i in range(30)], *[(60 + i, two) for i in range(40)],
    ]
    got = {r.doc_id: (r.n_deleted, r.text) for r in line_dedup.without_repeats(frame(spark, rows)).collect()}
    assert got[1][0] == got[3][0] == 0 and got[2] == (2, "\nother") and got[4] == (1, "x\nshort line")
    # Lines that are no passage stay, also where they recur in many documents.
    assert got[5][0] == got[6][0] == got[9][0] == 0 and all(got[20 + i][0] == 0 for i in range(30))
    assert got[8] == (3, "zero\nv") and all(got[60 + i] == (2, "") for i in range(40))


def test_no_later_passage_stays(spark):
    """Every run of lines that stays and makes a passage, of however many lines, is met for the first time."""
    rnd = random.Random(9)
    stock = [f"{i} " * rnd.choice([3, 12, 20, 28, 55]) for i in range(12)]
    rows = [(i, "\n".join(rnd.choice(stock) for _ in range(rnd.randrange(1, 9)))) for i in range(120)]
    kept, seen = {r.doc_id: r for r in line_dedup.without_repeats(frame(spark, rows)).collect()}, set()
    gone = 0
    for i, text in rows:
        lines = text.split("\n")
        late, sizes = set(), [len(x.split()) for x in lines]
        runs = [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines) + 1) if b - a >= 3 or sum(sizes[a:b]) >= 50]
        for a, b in sorted(runs, key=lambda r: (r[0], r[1] - r[0])):
            run = tuple(lines[a:b])
            if run in seen:
                late |= set(range(a, b))
            seen.add(run)
        gone += len(late)
        assert kept[i].text == "\n".join(x for j, x in enumerate(lines) if j not in late) and kept[i].n_deleted == len(late)
    assert gone > 50


def test_line_dedup_of_lines_that_share_64_bits(spark):
    one, other = "first line no. 1", "bhlzqqupvXaZ&qBI"
    assert spark.range(1).select(F.xxhash64(F.lit(one)) == F.xxhash64(F.lit(other))).first()[0]
    rows = [(1, f"{one}\np\nq"), (2, f"{other}\np\nq"), (3, f"{other}\np\nq")]
    got = line_dedup.without_repeats(frame(spark, rows)).collect()
    assert {r.doc_id: r.n_deleted for r in got} == {1: 0, 2: 0, 3: 3}
    alone = line_dedup.without_repeats(frame(spark, [(1, one), (2, other), (3, one)]), passage_words=1).collect()
    assert {r.doc_id: r.n_deleted for r in alone} == {1: 0, 2: 0, 3: 1}


def vectors(n, width, seed, top=2.0):
    return np.random.default_rng(seed).normal(0, top, (n, width))


def test_threshold_search_stops_early_and_is_exact():
    # Long tails let the threshold fall below the kth result before all is seen.
    x = (np.random.default_rng(1).pareto(1.2, (3000, 6)) * 64).astype(np.int64)
    ids, q_ids, q = np.arange(3000), np.arange(0, 3000, 100), x[::100] % 97 - 20
    rows, found, scores, scored = top_k.threshold_search(q_ids, q, ids, x, 5)
    assert scored < len(q) * 3000 * 0.9
    for r in range(len(q)):
        every = sorted((-int(s), int(i)) for s, i in zip(q[r] @ x.T, ids) if i != q_ids[r])[:5]
        assert sorted((-int(s), int(i)) for s, i in zip(scores[rows == r], found[rows == r])) == every


def test_top_k(spark):
    x = vectors(300, 8, 3).round(1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows[50:80] = [(i, rows[20][1]) for i in range(50, 80)]
    rows += [(400, None), (420, [1.0, None] + [0.0] * 6), (440, [float("nan")] + [0.0] * 7), (460, [float("inf")] * 8), (480, []), (None, [9.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, "z") for i, v in rows], "vec_id long, embedding array<float>, score int, rank string")
    got = {}
    for r in top_k.top_k(df, F.col("vec_id") % 20 == 0, k=20, block=64, query_block=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    sound = {i: np.floor(64 * np.float32(v).astype(float)).astype(int) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    want = {}
    for q in (i for i in sound if i % 20 == 0):
        scores = sorted((-(int(sound[q] @ v) if len(v) == len(sound[q]) else 0), i) for i, v in sound.items() if i != q)[:20]
        want[q] = [(i, -s) for s, i in scores]
    assert got == want
    assert top_k.top_k(df.where("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0
    assert len(got[480]) == 20 and top_k.top_k(df.where("vec_id in (0, 20, 21)"), F.col("vec_id") == 0).count() == 2


def test_blocks_below_the_floor_are_not_read(spark, monkeypatch):
    seen = []
    x = vectors(1200, 6, 4) * np.random.default_rng(2).pareto(0.8, (1200, 1))
    q = np.floor(64 * x).astype(np.int64)
    order = np.argsort(-(q.astype(float) ** 2).sum(axis=1), kind="stable")
    floors = np.sort(q[::60] @ q[order[:100]].T, axis=1)[:, -5]
    for low in range(100, 1200, 100):
        block = q[order[low : low + 100]]
        *_, scored = top_k.threshold_search(np.arange(0, 1200, 60), q[::60], order[low : low + 100], block, 5, floors=floors)
        seen.append(scored / (20 * 100))
    assert np.mean(seen) < 0.6 and seen[-1] < seen[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in top_k.top_k(df, F.col("vec_id") % 60 == 0, k=5, block=100, query_block=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {i: [(j, -s) for s, j in sorted((-int(q[i] @ v), j) for j, v in enumerate(q) if j != i)[:5]] for i in range(0, 1200, 60)}


def test_top_k_of_wide_components(spark):
    """Components beyond 2^53 keep their value; what does not fit 64 bits is an error."""
    rows = [(0, [1.0, 0.0]), (1, [2.0**50, 0.0]), (2, [2.0**49, 0.0]), (3, [2.0**48, 0.0]), (4, [-(2.0**50), 1.0])]

    def found(more):
        df = spark.createDataFrame([*rows, *more], "vec_id long, embedding array<double>")
        return [(r.vec_id, r.score) for r in top_k.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()]

    assert found([]) == [(1, 2**62), (2, 2**61), (3, 2**60), (4, -(2**62))]
    for wide in (2.0**52, 2.0**60):  # its score, then its component
        with pytest.raises(Exception, match="does not fit 64 bits"):
            found([(5, [wide, 0.0])])


def test_words_and_slices():
    import pyarrow as pa

    w = words.Words(pa.array(["A b\x0bÀ c  ", None, "", " \x1c a"]))
    assert [w.distinct[i].as_py() for i in w.codes] == ["a", "b", "À c", "\x1c", "a"] and w.sizes().tolist() == [3, 0, 0, 2]
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (1, 5, 100, 0, 2)])], names=["t"])
    assert [b.num_rows for b in words.slices([batch], "t", 6)] == [2, 1, 2]
