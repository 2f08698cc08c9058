"""Ingestion deals out and makes its rows once."""

import re

from pyspark.sql import functions as F

from ledgerlake.functions import names
from ledgerlake.operators import cells as c
from ledgerlake.operators import ingest as ingest_module
from ledgerlake.operators import warehouse
from ledgerlake.operators.ordered import Ordered
from ledgerlake.plans import cells as plans
from ledgerlake.plans import registry

KEYS = ["sheet"]


def lineitem(spark, path, n=1200):
    rows = spark.range(n).selectExpr(
        "id div 4 as l_orderkey", "pmod(xxhash64(id), 200) as l_partkey", "pmod(xxhash64(id, 7), 36) as l_suppkey", "cast(id % 50 as double) as l_quantity")
    rows.write.parquet(f"{path}/lineitem.parquet")


def counting(monkeypatch, seen):
    """Count the rows of views that plans make."""
    real = plans.view

    def view(spark, d, name, heavy=False):
        @F.udf("string")
        def touched(v):
            seen.add(1)
            return v
        return real(spark, d, name, heavy).withColumn("value", touched("value"))

    monkeypatch.setattr(plans, "view", view)


def test_the_grid_of_a_batch_is_made_once(spark, tmp_path, monkeypatch):
    lineitem(spark, str(tmp_path))
    for name in ("detected_columns", "ingest_sheets", "ingest_tables"):
        seen = spark.sparkContext.accumulator(0)
        counting(monkeypatch, seen)
        n = registry.QUERIES[name](spark, str(tmp_path)).count()
        monkeypatch.undo()
        grid = plans.view(spark, str(tmp_path), "mixed_v" if name == "ingest_tables" else "grid_v")
        assert n > 0 and seen.value == grid.count(), name


def test_tables_of_sheets_of_one_tile_are_numbered_where_they_are_found(spark, monkeypatch):
    rows = [(s, r * 2, k, "x") for s in "abc" for r in range(20) for k in (0, 1, 4, 7, 8)]
    df = spark.createDataFrame(rows, "sheet string, row bigint, col int, value string")
    monkeypatch.setattr(c, "numbered", None)
    found = c.detect_tables(df, KEYS).collect()
    # A lone cell counts for nothing.
    want = {(s, r * 2, k, 2 * r + 1 + i) for s in "abc" for r in range(20) for i, k in enumerate((0, 7))}
    assert {(x.sheet, x.r0, x.c0, x.table_no) for x in found} == want and len(found) == len(want)


def test_cells_look_into_one_grid_for_all_small_tables(spark):
    boxes = [(0, 1, 0, 1), (10, 49, 0, 3), (60, 62, 0, 200), (70, 325, 0, 255)]
    tables = spark.createDataFrame([("s", i, *b) for i, b in enumerate(boxes)], "sheet string, table_no int, r0 bigint, r1 bigint, c0 bigint, c1 bigint")
    spread = c.squares(tables, KEYS)
    assert spread.select("_lr", "_lc").distinct().count() == 1
    reach = {r.table_no: r["count"] for r in spread.groupBy("table_no").count().collect()}
    assert all(reach[i] <= max(b[1] - b[0], b[3] - b[2]) + 1 + 5 for i, b in enumerate(boxes) if i != 3) and reach[3] <= 18 * 18


def test_keys_of_few_rows_need_no_blocks(spark, tiny_groups):
    df = spark.range(2000).selectExpr("id % 100 as k", "id as i", "cast(id as int) as v")
    o = Ordered(df, ["k"], [F.col("i")])
    assert o.one_block
    assert o.number("n").done().where("n <> i div 100 + 1").count() == 0
    # One key of many rows among them has blocks.
    assert not Ordered(df.withColumn("k", F.when(F.col("i") < 60, 5).otherwise(F.col("k"))).where("k = 5 or i > 100"), ["k"], [F.col("i")]).one_block


def test_suffixes_deal_names_out_once(spark):
    rows = [(None, i, n) for i, n in enumerate(["a", "a", "a_1", "b"])] + [("t", i, n) for i, n in enumerate(["a", "a", "a"])]
    df = spark.createDataFrame(rows, "t string, p int, n string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = names.dedup_names(df, ["t"], "p", "n")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert {(r.t, r.p): r.final_name for r in out.collect()} == {
            (None, 0): "a", (None, 1): "a_2", (None, 2): "a_1", (None, 3): "b", ("t", 0): "a", ("t", 1): "a_1", ("t", 2): "a_2"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # One exchange of the rows and one of the suffixes in use.
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2


def test_cells_inside_tables_are_found_once(spark, tmp_path, monkeypatch):
    rows = [("s", r, k, v) for r, line in enumerate(["a,b", "1,2", "3,4"]) for k, v in enumerate(line.split(","))]
    df = spark.createDataFrame(rows, "sheet string, row bigint, col int, value string")
    tables, inside, columns, sheets = ingest_module.ingest_cells(df, KEYS, "sheet", F.lit("ab-cd-ef-0123"))
    stored = warehouse.data_rows(inside, columns, sheets, KEYS).collect()
    assert sorted((r.row, r.cells["a"], r.cells["b"]) for r in stored) == [(0, "1", "2"), (1, "3", "4")]
    assert tables.count() == 1 and "InMemoryFileIndex" in inside._jdf.queryExecution().executedPlan().toString()
