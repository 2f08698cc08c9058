import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import text as tx
from ledgerlake.functions.vectors import embed_text


def windows(t, size=1000, step=900):
    return [t[i:i + size].replace("\x00", "") for i in range(0, len(t), step)]


def pack(t, size=1000, overlap=200):
    out, cur = [], ""
    for p in filter(None, (p.strip() for p in re.split(r"\n\s*\n", t))):
        if cur and len(cur) + len(p) > size:
            out.append(cur)
            words = cur.split()
            cur = (" ".join(words[-overlap:]) if len(words) > overlap else cur) + "\n\n" + p
        else:
            cur = f"{cur}\n\n{p}" if cur else p
    return out + [cur] if cur else out


def chunks(spark, fn, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = tx.chunk_rows(df, fn(F.col("t")), ["i"]).orderBy("i", "chunk_index").collect()
    return [[r.chunk_text for r in rows if r.i == i] for i in range(len(texts))], rows


@pytest.mark.parametrize("alphabet", ["ab \n", "aé😀\n", "a\x00b"])
def test_fixed_chunks(spark, alphabet):
    rnd = random.Random(1)
    texts = ["".join(rnd.choices(alphabet, k=n)) for n in (0, 1, 900, 901, 1000, 1001, 1900, 5000)]
    got, _ = chunks(spark, tx.fixed_chunks, texts)
    assert got == [windows(t) for t in texts]


def test_chunk_of_1000_has_a_tail_inside_the_overlap(spark):
    got, rows = chunks(spark, tx.fixed_chunks, ["x" * 1000])
    assert [len(c) for c in got[0]] == [1000, 100]
    assert [r.chunk_index for r in rows] == [0, 1]


def test_chunks_rebuild_the_text(spark):
    t = "".join(random.Random(2).choices("abc \n", k=12345))
    got, _ = chunks(spark, tx.fixed_chunks, [t])
    assert "".join(c[:900] for c in got[0][:-1]) + got[0][-1] == t


def test_paragraph_chunks(spark):
    rnd = random.Random(3)
    para = lambda n: " ".join("w" * rnd.randint(1, 9) for _ in range(n))
    texts = [
        "", "  \n\n \t\n", "one", "x" * 1500, "\n\n".join([para(30)] * 40),
        "\n\n".join(["a " * 199 + "a", para(150), para(10)]), "\n\n".join(["a " * 200 + "a", para(150), para(10)]),
        "\n \n".join(para(rnd.randint(0, 120)) for _ in range(60)), "a \n \nb\n\n" + "c" * 999 + "\n\nd",
    ]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "no key"), (99, None)], "i int, t string")
    rows = tx.paragraph_chunk_rows(df, "t", ["i"]).orderBy("i", "chunk_index").collect()
    assert [[r.chunk_text for r in rows if r.i == i] for i in range(len(texts))] == [pack(t) for t in texts]
    assert [(r.chunk_index, r.chunk_text) for r in rows if r.i is None] == [(0, "no key")]


def test_long_text_is_passed_on_in_slices(spark, monkeypatch):
    monkeypatch.setattr(tx, "_SLICE", 5000)
    t = "\n\n".join(f"paragraph {i} of many words" for i in range(5000))
    df = spark.createDataFrame([(1, t), (2, "end")], "i int, t string")
    rows = tx.paragraph_chunk_rows(df, "t", ["i"]).orderBy("i", "chunk_index").collect()
    assert [r.chunk_text for r in rows if r.i == 1] == pack(t)
    assert [r.chunk_index for r in rows if r.i == 1] == list(range(len(rows) - 1))


def test_entities(spark):
    t = ("Paid $1,234.56 and usd 1000, Rs. 5,000.50, INR 7 or € 8.5 £9 on 2024-01-02, 1/2/2024 and jan 5, 2024; "
         "12.5 % and 3% by Blue River Trading Corp and Acme Steel Ltd, not acme ltd")
    r = spark.createDataFrame([(t,), ("nothing here",)], "t string").select(tx.entities(F.col("t")).alias("e")).collect()
    assert r[0].e.asDict() == {
        "amounts": ["$1,234.56", "usd 1000,", "Rs. 5,000.50", "INR 7", "€ 8.5", "£9"],
        "dates": ["24-01-02", "1/2/2024", "2024-01-02", "jan 5, 2024"],
        "percentages": ["12.5 %", "3%"], "companies": ["Blue River Trading", "Acme Steel"],
    }
    assert r[1].e.asDict() == {"amounts": [], "dates": [], "percentages": [], "companies": []}


@pytest.mark.parametrize("t", ["٣٤/١/٢٠٢٤ and ٥ %", "uſd 5", "ınr 6 İnr 7"])
def test_entities_of_other_scripts_match_the_plain_patterns(spark, t):
    got = spark.createDataFrame([(t,)], "t string").select(tx.entities(F.col("t")).alias("e")).first().e
    expected = [m for p in tx.AMOUNT_PATTERNS[:2] for m in re.findall(p, t, re.IGNORECASE)]
    assert [a for a in got.amounts if not a.lower().startswith(("i", "ı", "İ"))] == expected
    assert got.dates == [m for p in tx.DATE_PATTERNS for m in re.findall(p, t, re.IGNORECASE)]
    assert got.percentages == re.findall(tx.PERCENT_PATTERN, t)


def test_entity_counts(spark):
    df = spark.createDataFrame([("$5 and 3%",), ("$5",)], "t string").select(tx.entities(F.col("t")).alias("entities"))
    got = {(r.kind, r.value): r.n for r in tx.entity_counts(df).collect()}
    assert got == {("amounts", "$5"): 2, ("percentages", "3%"): 1}


def test_pages_and_paragraphs(spark):
    df = spark.createDataFrame([(1, [" a ", "  ", "b"]), (2, ["\n"])], "f int, p array<string>")
    pages = tx.pages_to_rows(df, "p", ["f"]).orderBy("f", "page_number").collect()
    assert [tuple(r) for r in pages] == [(1, 1, "a"), (1, 3, "b")]
    assert [r.t for r in df.orderBy("f").select(tx.paragraphs_to_text(F.col("p")).alias("t")).collect()] == ["a\n\nb", ""]


def test_embed_text(spark):
    df = spark.createDataFrame([(1, "red wine"), (2, " "), (3, None), (4, "red red wine"), (5, "blue")], "i int, t string")
    got = {r.i: r.embedding for r in embed_text(df, "t", 64).collect()}
    assert len(got) == 5 and got[2] is None and got[3] is None
    for i in (1, 4, 5):
        assert len(got[i]) == 64 and abs(sum(x * x for x in got[i]) - 1) < 1e-5
    near = lambda a, b: sum(x * y for x, y in zip(got[a], got[b]))
    assert near(1, 4) > near(1, 5)


def _hits(spark, values):
    """One row of entities per value, as amounts."""
    made = spark.createDataFrame([(v,) for v in values], "v string").repartition(6)
    none = F.array().cast("array<string>")
    return made.select(F.struct(F.array("v").alias("amounts"), none.alias("dates"), none.alias("percentages"), none.alias("companies")).alias("entities"))


@pytest.mark.parametrize("tracked", [64, 256, 4096])
@pytest.mark.parametrize("case", ["few heavy", "many rare", "ties", "none"])
def test_top_entities_are_exact(spark, case, tracked):
    rnd = random.Random(4)
    values = {
        # Ten values hold most hits; of thousands of rare ones the sketch keeps some only.
        "few heavy": [f"h{rnd.randrange(10)}" for _ in range(8000)] + [f"r{rnd.randrange(3000)}" for _ in range(3000)],
        "many rare": [f"r{rnd.randrange(4000)}" for _ in range(6000)],
        "ties": [f"t{i % 50}" for i in range(1000)],
        "none": [],
    }[case]
    df = _hits(spark, values)
    want = sorted(Counter(values).items(), key=lambda x: (-x[1], x[0]))
    for limit in (5, 200):
        top = tx.top_entities(df, limit, tracked=tracked)
        assert [(r.value, r.n) for r in top.collect()] == want[:limit]
        # Proved answers read what was counted; the others count all values.
        exact = "Aggregate" in top._jdf.queryExecution().executedPlan().toString()
        if case == "few heavy":
            assert exact == (tracked == 64 or (tracked == 256 and limit == 200))
