import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import profile as p


def test_infer_types(spark):
    df = spark.createDataFrame(
        [("1", "1.5", "true", "2024-01-02", "a", None, "007"), ("-2", "3", "False", "2024-01-03 10:00:00", "1", None, "1e3")],
        "i string, f string, b string, t string, s string, n string, m string")
    assert p.infer_types(df) == {
        "i": "INTEGER", "f": "DOUBLE PRECISION", "b": "BOOLEAN", "t": "TIMESTAMP", "s": "TEXT", "n": "TEXT",
        "m": "DOUBLE PRECISION"}


def test_infer_types_by_group(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "x"), ("b", None)], "k string, v string")
    assert {r.k: (r.filled, r.type) for r in p.infer_types_by(df, ["k"], "v").collect()} == {
        "a": (2, "INTEGER"), "b": (1, "TEXT")}


@pytest.mark.parametrize("name, dtype, role, strict", [
    ("Invoice Date", "TEXT", "date", "other"), ("margin", "INTEGER", "monthly_metric", "other"),
    ("paid", "TEXT", "identifier", "other"), ("holiday", "TEXT", "date", "other"),
    ("net_sales", "INTEGER", "revenue", "revenue"), ("net_sales", "TEXT", "other", "other"),
    ("shipping_cost", "DOUBLE PRECISION", "expense", "expense"), ("jan_2024", "INTEGER", "monthly_metric", "monthly_metric"),
    ("num_items", "INTEGER", "identifier", "identifier"), ("x", "TIMESTAMP", "date", "date"), ("vendor", "TEXT", "identifier", "identifier"),
])
def test_roles(spark, name, dtype, role, strict):
    df = spark.createDataFrame([(name, dtype)], "n string, t string")
    n, t = F.col("n"), F.col("t")
    assert tuple(df.select(p.column_role(n, t), p.column_role(n, t, strict=True)).first()) == (role, strict)


@pytest.mark.parametrize("name, dtype, role", [
    ("Year", "INTEGER", "dimension_time"), ("code", "INTEGER", "dimension_key"), ("total", "TEXT", "metric"),
    ("qty", "INTEGER", "metric"), ("colour", "TEXT", "dimension"),
])
def test_csv_roles(spark, name, dtype, role):
    df = spark.createDataFrame([(name, dtype)], "n string, t string")
    assert df.select(p.column_role_csv(F.col("n"), F.col("t"))).first()[0] == role


def test_profile(spark):
    df = spark.createDataFrame(
        [(1, "b", 2.0), (2, None, 3.0), (3, "a", 2.0), (4, "b", 4.0), (5, "c", 5.0), (6, "d", 2.0)],
        "pos int, name string, amount double")
    got = {r.original_name: r for r in p.column_profile(df, ["pos"]).collect()}
    assert got["name"].samples == ["b", "a", "c"]
    assert got["amount"].samples == ["2.0", "3.0", "4.0"]
    assert (got["amount"].type, got["amount"].role) == ("DOUBLE PRECISION", "revenue")


def test_descriptions(spark):
    row = spark.range(1).select(
        p.heuristic_summary(F.lit("S"), F.array(*[F.lit(f"c{i}") for i in range(12)]), F.lit(5)).alias("a"),
        p.heuristic_keywords(F.lit("S"), F.array(*[F.lit(f"c{i}") for i in range(12)])).alias("b"),
        p.fast_summary(F.lit(3), F.lit(2)).alias("c"),
        p.csv_file_summary(F.lit("f.csv"), F.array(F.lit("x"), F.lit("y"))).alias("d"),
    ).first()
    assert row.a == ("Structured data table 'S' containing columns: c0, c1, c2, c3, c4, c5, c6, c7, c8, c9. 5 rows.")
    assert row.b == "S, c0, c1, c2, c3, c4" and row.c == "Sheet with 3 rows and 2 columns"
    assert row.d == "Financial file 'f.csv' containing 2 sheets: x, y."


def test_paged_summary_reads_three_pages(spark):
    pages = spark.createDataFrame([(1, "a.pdf", i, f"p{i} " + "x" * 90) for i in range(1, 6)], "f int, n string, page_number int, page_text string")
    df = p.paged_file_summary(pages, "f", "n")
    row = df.first()
    want = " ".join(f"p{i} " + "x" * 90 for i in range(1, 4))[:200]
    assert row.summary == f"PDF Document 'a.pdf' containing 5 pages. Preview: {want}..."
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()
