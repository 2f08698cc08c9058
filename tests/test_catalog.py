import uuid

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import catalog as cat
from ledgerlake.schemas import COLUMN_META
from ledgerlake.session import new_path
from ledgerlake.sources.tables import append_table, read_table

ARRIVALS = [("x", 1, "A"), ("y", 2, "A"), ("x", 3, "A"), ("x", 4, "B"), ("y", 5, "C"), ("x", 6, "A"), ("x", 7, "A")]
WANT = {("x", 1): ("NEW", 1), ("x", 3): ("DUPLICATE", 1), ("x", 4): ("NEW", 2), ("x", 6): ("NEW", 3),
        ("x", 7): ("DUPLICATE", 3), ("y", 2): ("NEW", 1), ("y", 5): ("NEW", 2)}


def arrivals(spark, rows):
    return spark.createDataFrame(rows, "file_name string, arrival bigint, file_hash string")


def versions(df):
    return {(r.file_name, r.arrival): (r.status, r.version) for r in df.collect()}


def test_versions(spark):
    assert versions(cat.assign_versions(arrivals(spark, ARRIVALS))) == WANT


def test_versions_of_a_hot_name(spark, tiny_groups):
    assert versions(cat.assign_versions(arrivals(spark, ARRIVALS))) == WANT
    hot = [("hot", i, "AB"[(i // 3) % 2]) for i in range(300)]
    got = versions(cat.assign_versions(arrivals(spark, hot)))
    assert got == {("hot", i): ("NEW" if i % 3 == 0 else "DUPLICATE", i // 3 + 1) for i in range(300)}


@pytest.mark.parametrize("at", [1, 3, 4, 6])
def test_versions_continue_from_what_is_stored(spark, at):
    first = cat.assign_versions(arrivals(spark, ARRIVALS[:at]))
    stored = cat.latest_version(first.where("status = 'NEW'").select("file_name", "version", "file_hash"))
    second = cat.assign_versions(arrivals(spark, ARRIVALS[at:]), stored)
    assert versions(first) | versions(second) == WANT
    replay = cat.assign_versions(arrivals(spark, ARRIVALS[at:]), stored)
    assert versions(replay) == versions(second)


@pytest.fixture
def three(spark):
    files = spark.createDataFrame([("f1", "a", "2024-01-01"), ("f2", "b", "2024-01-03"), ("f3", "c", "2024-01-02")],
                                  "file_id string, file_name string, uploaded_at string")
    sheets = spark.createDataFrame(
        [("s1", "f1", "B", "t1", 3, None, "finance", "confidential"), ("s2", "f1", "A", "t2", None, "C", None, None),
         ("s3", "f2", "A", "t3", 4, "C", "general", "internal")],
        "sheet_id string, file_id string, sheet_name string, table_name string, num_rows bigint, category string, "
        "data_domain string, sensitivity_level string")
    chunks = spark.createDataFrame([("c1", "f1", "pdf"), ("c2", "f3", "text")], "chunk_id string, file_id string, kind string")
    return files, sheets, chunks


def test_queries(three):
    files, sheets, chunks = three
    assert [r.file_id for r in cat.list_files(files, 2).collect()] == ["f2", "f3"]
    assert [r.file_id for r in cat.list_files(files, 2, 2).collect()] == ["f1"]
    assert [r.sheet_id for r in cat.file_detail(files, sheets, "f1").collect()] == ["s2", "s1"]
    assert [r.sheet_id for r in cat.file_detail(files, sheets, "f3").collect()] == [None]
    assert cat.file_detail(files, sheets, "nope").count() == 0
    assert [(r.sheet_id, r.category) for r in cat.sheets_explorer(sheets, files).collect()] == [
        ("s3", "C"), ("s2", "C"), ("s1", "Uncategorized")]
    assert tuple(cat.catalog_stats(files, sheets, chunks).first()) == (3, 3, 7, 1)
    assert tuple(cat.catalog_stats(files, sheets.where("false"), chunks).first()) == (3, 0, 0, 1)


def test_changes(spark, three):
    files, sheets, chunks = three
    changed = cat.update_by_key(sheets, spark.createDataFrame([("s1", "New")], "sheet_id string, category string"), "sheet_id")
    assert {r.sheet_id: r.category for r in changed.collect()} == {"s1": "New", "s2": "C", "s3": "C"}
    gone = files.where("file_id = 'f1'")
    f, s, c, drops = cat.cascade_delete(files, sheets, chunks, gone)
    assert (f.count(), s.count(), c.count()) == (2, 1, 1)
    assert sorted(r.table_name for r in drops.collect()) == ["t1", "t2"]


def test_validate(spark, three):
    from ledgerlake.operators.policy import seed

    files, sheets, chunks = three
    row = cat.validate(files, sheets, chunks, seed(spark)).first()
    assert (row.files_count, row.orphan_sheets, row.unseen_sheets, row.is_healthy) == (3, 0, 1, True)
    row = cat.validate(files.where("file_id <> 'f1'"), sheets, chunks, seed(spark)).first()
    assert (row.orphan_sheets, row.orphan_chunks, row.is_healthy) == (2, 1, False)


def test_metadata_json(spark):
    df = spark.createDataFrame([('[{"name":"a","samples":["x"]}]',), ("[{",), (None,)], "t string")
    got = [r.m for r in df.select(cat.parse_columns_metadata(F.col("t"), COLUMN_META).alias("m")).collect()]
    assert got[0][0].name == "a" and got[0][0].samples == ["x"] and got[1] == [] and got[2] == []


def test_tables(spark):
    ids = {p: f"{p}{uuid.uuid4().hex[:8]}" for p in ("sheet_", "data_", "sheets_")}
    for name in ids.values():
        append_table(spark.createDataFrame([(1, float("nan")), (2, 1.5)], "x int, y double"), name, new_path(spark, "t"))
    append_table(spark.createDataFrame([(3, 2.5)], "x int, y double"), ids["sheet_"])
    got = read_table(spark, ids["sheet_"], ["x", "y"])
    assert sorted(map(tuple, got.collect())) == [(1, None), (2, 1.5), (3, 2.5)]
    assert "ReadSchema: struct<y:double>" in read_table(spark, ids["sheet_"], ["y"])._jdf.queryExecution().executedPlan().toString()
    cat.optimise(spark, ids["sheet_"])
    with pytest.raises(ValueError):
        cat.cleanup(spark)
    assert cat.cleanup(spark, confirm=True) == 0 and not cat.catalogue_exists(spark)
    named = spark.createDataFrame([("s1", ids["sheet_"]), ("s2", "gone"), ("s3", None)], "sheet_id string, table_name string")
    append_table(named, "sheets_metadata", new_path(spark, "t"))
    # Only what the catalogue names goes, whatever a table is called.
    assert cat.cleanup(spark, confirm=True) == 1
    assert not spark.catalog.tableExists(ids["sheet_"]) and spark.catalog.tableExists(ids["data_"])
    for name in (ids["sheets_"], ids["data_"], "sheets_metadata"):
        spark.sql(f"DROP TABLE {name}")


def test_compact(spark):
    path = new_path(spark, "compact")
    cat.compact(spark.range(100).repartition(20), path, rows_per_file=60)
    df = spark.read.parquet(path)
    assert df.count() == 100 and len(df.inputFiles()) == 2
