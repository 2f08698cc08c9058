import datetime as dt
import random
import re

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from ledgerlake.operators import warehouse
from ledgerlake.operators.cells import table_cells
from ledgerlake.operators import ingest as ingest_module
from ledgerlake.operators.ingest import first_samples, ingest, load_table

SHEET = [
    "Region,Net Sales,Net Sales,,Order,Empty",
    "north,1.5,2,x,2024-01-05,",
    "south,2,3,y,2024-01-06,",
    "north,4,,z,2024-01-07,",
]
OTHER = ["Key,Name", "7,a", "8,b"]


def cells(spark):
    rows = []
    for top, lines in ((0, SHEET), (6, OTHER)):
        for r, line in enumerate(lines):
            rows += [("S 1", top + r, c, v) for c, v in enumerate(line.split(","))]
    return spark.createDataFrame(rows, "sheet string, row bigint, col int, value string")


def test_ingest(spark):
    df = cells(spark)
    tables, columns, sheets = ingest(df, ["sheet"], "sheet", F.lit("ab-cd-ef-0123"))
    got = [(r.name, r.original_name, r.type, r.role, r.samples) for r in columns.where("table_no = 1").orderBy("col").collect()]
    assert got == [
        ("region", "Region", "TEXT", "other", ["north", "south"]),
        ("net_sales", "Net Sales", "DOUBLE PRECISION", "revenue", ["1.5", "2", "4"]),
        ("net_sales_1", "Net Sales", "INTEGER", "revenue", ["2", "3"]),
        ("unnamed", None, "TEXT", "identifier", ["x", "y", "z"]),
        ("_order", "Order", "TIMESTAMP", "date", ["2024-01-05", "2024-01-06", "2024-01-07"]),
    ]
    rows = {r.table_no: r for r in sheets.collect()}
    assert (rows[1].sheet_title, rows[1].table_name, rows[1].num_rows, rows[1].num_columns) == (
        "S 1_Table1", "sheet_s_1_table1_abcdef01", 3, 5)
    assert rows[2].summary == "Sheet with 2 rows and 2 columns" and rows[2].keywords == "_key, name"
    one = load_table(df, tables, columns, ["sheet"], (F.col("sheet") == "S 1") & (F.col("table_no") == 1))
    assert one.columns == ["region", "net_sales", "net_sales_1", "unnamed", "_order"]
    assert [tuple(r) for r in one.collect()] == [
        ("north", 1.5, 2, "x", dt.datetime(2024, 1, 5)), ("south", 2.0, 3, "y", dt.datetime(2024, 1, 6)),
        ("north", 4.0, None, "z", dt.datetime(2024, 1, 7))]


def test_sheets_whose_names_meet(spark):
    rows = [(s, r, c, v) for s in ("A b", "a_b") for r, line in enumerate(OTHER) for c, v in enumerate(line.split(","))]
    df = spark.createDataFrame(rows, "sheet string, row bigint, col int, value string")
    _, _, sheets = ingest(df, ["sheet"], "sheet", F.lit("ab-cd-ef-0123"))
    assert {r.sheet: r.table_name for r in sheets.collect()} == {"A b": "sheet_a_b_abcdef01", "a_b": "sheet_a_b_abcdef01_2"}


def test_headers_that_look_like_suffixed_ones(spark):
    rows = [(s, r, c, v) for s in ("S", "T") for r, line in enumerate(["a,a,a_1", "1,2,3"]) for c, v in enumerate(line.split(","))]
    df = spark.createDataFrame(rows, "sheet string, row bigint, col int, value string")
    tables, columns, sheets = ingest(df, ["sheet"], "sheet", F.lit("ab-cd-ef-0123"))
    one = load_table(df, tables, columns, ["sheet"], (F.col("sheet") == "S") & (F.col("table_no") == 1))
    assert one.columns == ["a", "a_2", "a_1"] and [tuple(r) for r in one.collect()] == [(1, 2, 3)]
    # A sheet like this does not end the batch.
    stored = warehouse.data_rows(table_cells(df, tables, ["sheet"]), columns, sheets, ["sheet"]).collect()
    assert [r.cells for r in stored] == [{"a": "1", "a_2": "2", "a_1": "3"}] * 2


def test_one_table_of_a_store_scans_few_row_groups(spark, tmp_path):
    many = spark.range(20_000).select(
        F.concat(F.lit("t"), F.floor(F.col("id") / 20).cast("string")).alias("table_name"), (F.col("id") % 20).alias("row"),
        F.create_map(F.lit("a"), F.col("id").cast("string")).alias("cells"))
    large = spark.range(50_000).select(F.lit("large").alias("table_name"), F.col("id").alias("row"), F.create_map(F.lit("a"), F.col("id").cast("string")).alias("cells"))
    path = str(tmp_path / "store")
    for batch in (many, large):
        warehouse.write_data(batch, path)
    files = list((tmp_path / "store").rglob("*.parquet"))
    assert len(files) < 3 * warehouse.BUCKETS
    one = warehouse.read_data(spark, path, "t77", [("a", "INTEGER")])
    assert sorted(r.a for r in one.collect()) == list(range(1540, 1560))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(table_name,t77)" in plan
    folders = {f.parent.name for f in files}
    scanned = {r.f.split("/")[-2] for r in warehouse.read_rows(spark, path, "t77").select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(folders) > 50 and len(scanned) == 1
    # Tables lie one after the other in a file, so statistics tell them apart.
    mine = [f for f in files if f.parent.name in scanned]
    assert all(pq.read_table(f)["table_name"].to_pylist() == sorted(pq.read_table(f)["table_name"].to_pylist()) for f in mine)
    assert warehouse.read_rows(spark, path).count() == 70_000


def test_samples_are_found_without_an_exchange_of_values(spark, monkeypatch):
    monkeypatch.setattr(ingest_module, "HELD_ROWS", 5)
    rnd = random.Random(3)
    rows = [(rnd.choice("pq") if rnd.random() < 0.9 else None, rnd.randrange(3), r, rnd.choice(["same"] * 20 + list("abcdef"))) for r in range(2000)]
    rnd.shuffle(rows)
    data = spark.createDataFrame(rows, "sheet string, col int, row long, value string").repartition(5)
    out = first_samples(data, ["sheet", "col"], "row", "value")
    want = {}
    for s, c, _, v in sorted(rows, key=lambda r: r[2]):
        found = want.setdefault((s, c), [])
        if v not in found and len(found) < 3:
            found.append(v)
    assert {(r.sheet, r.col): r.samples for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert all("value" not in x for x in re.findall(r"hashpartitioning\([^)]*\)", plan))
