import pytest

from ledgerlake.operators.answers import MetricSpec, answer, audited, best, is_meaningful
from ledgerlake.operators.warehouse import read_data, text_chunks, write_data


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "empty": spark.createDataFrame([], "k string, v int"),
        "zero": spark.createDataFrame([("a", 0)], "k string, v int"),
        "good": spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"),
    }


def candidates(spark, *names, raw=False):
    return spark.createDataFrame([(n, raw) for n in names], "table_name string, allow_raw_rows boolean").coalesce(1)


def test_first_meaningful_candidate_wins(spark, tables):
    def load(c):
        return tables[c.table_name]

    found = answer(spark, candidates(spark, "empty", "zero", "good"), "SELECT SUM(v) AS s FROM {table}", load)
    assert [(a.candidate.table_name, a.meaningful) for a in found] == [("empty", False), ("zero", False), ("good", True)]
    assert best(found).result.collect()[0].s == 3
    found = answer(spark, candidates(spark, "good", "zero"), MetricSpec("total", {"value": "v", "by": ["k"]}), load)
    assert len(found) == 1 and sorted(map(tuple, found[0].result.collect())) == [("a", 1), ("b", 2)]
    found = answer(spark, candidates(spark, "zero", "empty"), "SELECT MAX(v) FROM {table}", load)
    assert best(found).candidate.table_name == "zero"


def test_statement_that_shows_rows_is_refused(spark, tables):
    found = answer(spark, candidates(spark, "good"), "SELECT * FROM {table}", lambda c: tables[c.table_name])
    assert best(found) is None and found[0].reason == "raw rows not allowed"
    found = answer(spark, candidates(spark, "good", raw=True), "SELECT * FROM {table}", lambda c: tables[c.table_name])
    assert best(found).result.count() == 2
    with pytest.raises(ValueError):
        MetricSpec("with_running_total").run(tables["good"])


@pytest.mark.parametrize("sql, ok", [
    ("SELECT vendor, SUM(amount) FROM t GROUP BY vendor", True), ("SELECT * FROM t", False), ("SELECT vendor, amount FROM t", False),
    ("select count(*) from t", True),
])
def test_audit(spark, sql, ok):
    assert audited(spark, sql, False)[0] == ok and audited(spark, sql, True)[0]


@pytest.mark.parametrize("value, good", [(None, False), (0.0, False), (float("nan"), False), (2.0, True)])
def test_single_cells(spark, value, good):
    assert is_meaningful(spark.createDataFrame([(value,)], "x double")) == good


def test_data_tables(spark, tmp_path):
    rows = spark.createDataFrame(
        [("t1", 0, {"a": "1", "b": "x"}), ("t1", 1, {"a": "no"}), ("t2", 0, {"c": "2.5"})], "table_name string, row long, cells map<string,string>")
    write_data(rows, str(tmp_path / "d"))
    one = read_data(spark, str(tmp_path / "d"), "t1", [("a", "INTEGER"), ("b", "TEXT")])
    assert sorted(map(tuple, one.collect()), key=repr) == [(1, "x"), (None, None)]
    assert read_data(spark, str(tmp_path / "d"), "t2", [("c", "DOUBLE PRECISION")]).first().c == 2.5
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().executedPlan().toString()


def test_text_chunks(spark):
    df = spark.createDataFrame([("f", "paid $5 " + "x" * 1000)], "file_id string, text string")
    got = text_chunks(df, "text", "file_id").orderBy("chunk_index").collect()
    assert [(r.kind, r.chunk_index, len(r.chunk_text)) for r in got] == [("text", 0, 1000), ("text", 1, 108)]
    assert got[0].entities.amounts == ["$5"] and len({r.chunk_id for r in got}) == 2
