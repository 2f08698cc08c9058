import random

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import cells as c
from ledgerlake.operators.components import _with_smallest, components

KEYS = ["sheet"]


def grid(spark, sheets):
    rows = [(s, r, k, str(v)) for s, cells in sheets.items() for (r, k), v in cells.items()]
    return spark.createDataFrame(rows, "sheet string, row bigint, col int, value string")


def flood(cells):
    """Rectangles of 8-connected groups in order of their first cell."""
    left, out = set(cells), []
    for start in sorted(cells):
        if start not in left:
            continue
        stack, seen = [start], []
        left.discard(start)
        while stack:
            r, k = stack.pop()
            seen.append((r, k))
            for n in [(r + a, k + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if n in left:
                    left.discard(n)
                    stack.append(n)
        rs, ks = [x[0] for x in seen], [x[1] for x in seen]
        out.append((min(rs), max(rs), min(ks), max(ks), len(seen)))
    return out


def expected(sheets, min_area=2):
    out = set()
    for s, cells in sheets.items():
        boxes = [b for b in flood(cells) if (b[1] - b[0] + 1) * (b[3] - b[2] + 1) >= min_area]
        out |= {(s, *b, i + 1) for i, b in enumerate(boxes)}
    return out


def detected(df, **kw):
    return {(r.sheet, r.r0, r.r1, r.c0, r.c1, r.n_cells, r.table_no) for r in c.detect_tables(df, KEYS, **kw).collect()}


def block(r0, r1, c0, c1):
    return {(r, k): 1 for r in range(r0, r1 + 1) for k in range(c0, c1 + 1)}


def ring(n):
    return {(r, k): 1 for r in range(n) for k in range(n) if r in (0, n - 1) or k in (0, n - 1)}


SHAPES = {
    "single": {(3, 3): 1},
    "diagonal": {(0, 0): 1, (1, 1): 1},
    "ring": {**ring(9), **{(r + 4, k + 4): 1 for r, k in block(0, 1, 0, 0)}},
    "gap": {**block(0, 2, 0, 2), **block(4, 6, 0, 2)},
    "touch": {**block(0, 2, 0, 2), **block(3, 5, 3, 4)},
    "snake": {(r, k): 1 for r in range(0, 40, 2) for k in range(12)} | {(r, 11 if r % 4 == 1 else 0): 1 for r in range(1, 39, 2)},
    "long": block(0, 130, 0, 1),
    "edge": {(r, 7 if r % 2 else 8): 1 for r in range(20)},
}


def random_sheets():
    rnd = random.Random(7)
    return {f"s{i}": {(r, k): 1 for r in range(30) for k in range(17) if rnd.random() < 0.1 + 0.05 * i} for i in range(8)}


@pytest.mark.parametrize("tile", [3, 8, 256])
def test_rectangles(spark, tile):
    sheets = SHAPES | random_sheets()
    assert detected(grid(spark, sheets), tile=tile) == expected(sheets)


def test_all_rectangles(spark):
    got = c.detect_tables(grid(spark, {"a": {(0, 0): 1}}), KEYS, min_area=1).collect()
    assert [(r.r0, r.r1, r.c0, r.c1) for r in got] == [(0, 0, 0, 0)]


def test_batches_smaller_than_a_tile(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert detected(grid(spark, SHAPES)) == expected(SHAPES)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_numbering_of_a_sheet_with_many_tables(spark, tiny_groups):
    sheets = {"many": {(r * 3, k): 1 for r in range(30) for k in (0, 1, 5, 6)}, "few": block(0, 1, 0, 1)}
    assert detected(grid(spark, sheets)) == expected(sheets)


def test_empty_sheet_and_blank_cells(spark):
    df = grid(spark, {"a": {(0, 0): "  ", (0, 1): "\t", (1, 1): "x"}})
    kept = c.nonblank(df)
    assert kept.count() == 1
    assert c.detect_tables(kept, KEYS).count() == 0
    assert c.detect_tables(kept.where("false"), KEYS).count() == 0


def test_duplicate_cells(spark):
    df = grid(spark, {"a": block(0, 1, 0, 1)})
    assert {x[:5] for x in detected(df.unionByName(df))} == {("a", 0, 1, 0, 1)}


@pytest.mark.parametrize("bits", [(1, 2), c.SQUARE_BITS])
def test_table_cells_may_share_cells(spark, bits, monkeypatch):
    monkeypatch.setattr(c, "SQUARE_BITS", bits)
    df = grid(spark, {"ring": SHAPES["ring"]})
    inside = c.table_cells(df, c.detect_tables(df, KEYS), KEYS)
    got = sorted((r.table_no, r.row, r.col) for r in inside.collect())
    want = sorted(
        (no, r, k) for s, r0, r1, c0, c1, _, no in expected({"ring": SHAPES["ring"]})
        for r, k in SHAPES["ring"] if r0 <= r <= r1 and c0 <= k <= c1
    )
    assert got == want and len(got) > len(SHAPES["ring"])


def test_rectangles_reach_four_squares_at_most(spark):
    # A long diagonal, a tall and a wide rectangle, and rectangles across the borders of squares.
    boxes = [(0, 99_999, 0, 99_999), (0, 1_000_000, 3, 5), (7, 7, 0, 60_000), (15, 16, 255, 256), (4_095, 4_097, 65_535, 65_537)]
    tables = spark.createDataFrame([("s", i, *b) for i, b in enumerate(boxes)], "sheet string, table_no int, r0 bigint, r1 bigint, c0 bigint, c1 bigint")
    assert max(r["count"] for r in c.squares(tables, KEYS).groupBy("table_no").count().collect()) <= 4
    cells = spark.createDataFrame([("s", r, k) for r, k in ((16, 255), (999_999, 4), (7, 59_999), (4_096, 65_536), (100_000, 100_000), (50, 99_999))], "sheet string, row bigint, col bigint")
    got = sorted((r.table_no, r.row, r.col) for r in c.table_cells(cells, tables, KEYS).collect())
    assert got == sorted((i, r.row, r.col) for i, (a, b, x, y) in enumerate(boxes) for r in cells.collect() if a <= r.row <= b and x <= r.col <= y)


@pytest.mark.parametrize("stripe", [1, 3, 16])
def test_stripes_of_large_squares(spark, stripe, monkeypatch):
    monkeypatch.setattr(c, "STRIPE_BITS", stripe)
    boxes = [(0, 40, 0, 2), (5, 5, 1, 9), (17, 300, 4, 6), (250, 251, 0, 300)]
    tables = spark.createDataFrame([("s", i, *b) for i, b in enumerate(boxes)], "sheet string, table_no int, r0 bigint, r1 bigint, c0 bigint, c1 bigint")
    cells = spark.range(320).selectExpr("'s' as sheet", "id as row", "explode(sequence(0, 12)) as col").withColumn("col", F.col("col").cast("long"))
    got = sorted((r.table_no, r.row, r.col) for r in c.table_cells(cells, tables, KEYS).collect())
    assert got == sorted((i, r, k) for i, (a, b, x, y) in enumerate(boxes) for r in range(320) for k in range(13) if a <= r <= b and x <= k <= y)


def test_header_and_typed_table(spark):
    cells = {(2, 1): "Name", (2, 2): "Net", (3, 1): "a", (3, 2): "1.5", (4, 1): "b", (4, 2): "x"}
    df = grid(spark, {"s": cells})
    inside = c.table_cells(df, c.detect_tables(df, KEYS), KEYS)
    data = c.promote_header(inside, KEYS)
    assert sorted((r.data_row, r.header, r.value) for r in data.collect()) == [
        (0, "Name", "a"), (0, "Net", "1.5"), (1, "Name", "b"), (1, "Net", "x")]
    wide = c.cells_to_table(data, ["sheet", "table_no", "data_row"], {1: ("name", "string"), 2: ("net", "double")})
    assert sorted((r.data_row, r.name, r.net) for r in wide.collect()) == [(0, "a", 1.5), (1, "b", None)]


def test_sheet_names(spark):
    df = grid(spark, {"one": block(0, 1, 0, 1), "two": SHAPES["gap"]})
    got = {(r.sheet, r.table_no): r.clean_name for r in c.table_names(c.detect_tables(df, KEYS), KEYS, "sheet").collect()}
    assert got == {("one", 1): "one", ("two", 1): "two_Table1", ("two", 2): "two_Table2"}


def test_components_of_random_graphs(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(200)]
    edges += [(5000, 5001 + i) for i in range(150)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    assert {r.node: r.label for r in components(df).collect()} == {n: find(n) for n in nodes}


def test_one_python_step_only(spark):
    df = grid(spark, {"a": block(0, 3, 0, 3)})
    plan = c._tile_groups(df, KEYS, 256, False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and plan.count("Exchange") == 1
    inside = c.table_cells(df, c.detect_tables(df, KEYS), KEYS)
    assert "Cartesian" not in inside._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in inside._jdf.queryExecution().executedPlan().toString()


def test_a_star_of_many_edges_has_no_hot_task(spark):
    star = spark.range(1, 1_000_001).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "4"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        joined = _with_smallest(star.repartition(8))
        tasks = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(tasks) == 1_000_000 and tasks[-1] <= 2 * tasks[len(tasks) // 2] and len(tasks) > 1
    labels = components(star)
    assert labels.agg(F.count("*"), F.max("label")).first() == (1_000_001, 0)
