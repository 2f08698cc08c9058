import random

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators.ordered import Ordered, numbered


def rows(n=400):
    rnd = random.Random(11)
    # One key holds well over a third of the rows.
    return [("hot" if rnd.random() < 0.5 else f"k{rnd.randrange(9)}", i, rnd.randrange(5) if rnd.random() < 0.9 else None)
            for i in range(n)]


def by_key(data):
    out = {}
    for k, i, v in sorted(data, key=lambda r: r[1]):
        out.setdefault(k, []).append((i, v))
    return out


def check(spark):
    data = rows()
    df = spark.createDataFrame(data, "k string, i bigint, v int")
    o = Ordered(df, ["k"], [F.col("i")])
    got = {(r.k, r.i): (r.prev, r.total) for r in o.lag("v", "prev").running_sum(F.col("v"), "total").done().collect()}
    want = {}
    for k, items in by_key(data).items():
        total, prev = None, None
        for i, v in items:
            total = total if v is None else (total or 0) + v
            want[k, i] = (prev, total)
            prev = v
    assert got == want


def test_against_a_loop(spark):
    check(spark)


def test_large_groups_are_cut_into_blocks(spark, tiny_groups):
    check(spark)


def test_row_numbers_without_keys(spark, tiny_groups):
    df = spark.range(100)
    got = {r.id: r.n for r in numbered(df, [], [F.col("id")], "n").collect()}
    assert got == {i: i + 1 for i in range(100)}


@pytest.mark.usefixtures("tiny_groups")
def test_null_keys(spark):
    df = spark.createDataFrame([(None, i) for i in range(30)], "k string, i int")
    assert sorted(r.n for r in numbered(df, ["k"], [F.col("i")], "n").collect()) == list(range(1, 31))


def test_no_block_is_the_whole_group(spark, tiny_groups):
    df = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").alias("i"))
    o = Ordered(df, ["k"], [F.col("i")])
    sizes = [r["count"] for r in o.df.groupBy("_block").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 4000
