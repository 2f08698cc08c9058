import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.functions.vectors import confidence, cosine_distance, wrong_dims
from ledgerlake.operators import retrieval as r
from ledgerlake.operators.policy import seed


def corpus(spark, n=300, dim=8, ties=False):
    rnd = np.random.default_rng(3)
    v = rnd.normal(size=(n, dim)).astype("float32")
    if ties:
        v[50:150] = v[0]
    rows = [(i, [float(x) for x in v[i]]) for i in range(n)] + [(n, None), (n + 1, [0.0] * dim)]
    return v.astype("float64"), spark.createDataFrame(rows, "id bigint, v array<float>")


def brute(v, q, k):
    d = 1 - v @ q / (np.linalg.norm(v, axis=1) * np.linalg.norm(q))
    return [int(i) for i in np.lexsort((np.arange(len(v)), np.round(d, 12)))[:k]]


@pytest.mark.parametrize("ties", [False, True])
def test_nearest(spark, ties):
    v, df = corpus(spark, ties=ties)
    q = [float(x) for x in v[0]]
    got = [row.id for row in r.nearest(df.repartition(5), "v", q, 7, ["id"]).collect()]
    assert got == brute(v, np.array(q), 7)


@pytest.mark.parametrize("block", [2, 1024])
@pytest.mark.parametrize("k", [1, 5, 400])
def test_nearest_many(spark, monkeypatch, block, k):
    monkeypatch.setattr(r, "QUERY_BLOCK", block)
    v, df = corpus(spark, ties=True)
    queries = {f"q{i}": [float(x) for x in v[i]] for i in (0, 3, 170, 200, 250)}
    rows = r.nearest_many(df.repartition(6), "v", "id", queries, k).collect()
    for name, q in queries.items():
        got = [x.id for x in sorted((x for x in rows if x.query_id == name), key=lambda x: x["rank"])]
        assert got == brute(v, np.array(q), k)


def test_distance_edge_cases(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<float>, b array<float>")
    assert [x.d for x in df.select(cosine_distance(F.col("a"), F.col("b")).alias("d")).collect()] == [1.0, None, None]
    assert df.select(confidence(F.lit(0.126)).alias("c")).first().c == "0.87"
    assert [tuple(x) for x in wrong_dims(df, "a", 3).collect()] == [(2, 2)]


@pytest.fixture
def catalogue(spark):
    sheets = spark.createDataFrame(
        [("s1", "f1", "A", "t1", "Sales", "finance", "confidential", [1.0, 0.0]), ("s2", "f2", "B", "t2", None, None, None, [0.9, 0.1]),
         ("s3", "f2", "C", "t3", "HR", "hr", "confidential", [1.0, 0.0]), ("s4", "f1", "D", "t4", "x", None, "x", None)],
        "sheet_id string, file_id string, sheet_name string, table_name string, category string, data_domain string, "
        "sensitivity_level string, summary_embedding array<float>")
    files = spark.createDataFrame([("f1", "sales_100%.csv"), ("f2", "Staff.csv")], "file_id string, file_name string")
    return sheets, files, seed(spark)


def test_hybrid_search(catalogue):
    q = [1.0, 0.0]
    ids = lambda role, text, k=3: [x.sheet_id for x in r.hybrid_search(*catalogue, role, text, q, k).collect()]
    assert ids("Analyst", "nothing") == ["s1", "s2", "s4"]
    assert ids("Analyst", "STAFF") == ["s2", "s1", "s4"]
    assert ids("Guest", "nothing") == ["s2", "s4"]
    # Percent signs and underscores of a question are literal.
    assert ids("Analyst", "%") == ["s1", "s4", "s2"] and ids("Analyst", "s_aff") == ["s1", "s2", "s4"]
    answer = r.metadata_answer(*catalogue, "Analyst", "which file", q).first()
    assert tuple(answer) == ("sales_100%.csv", "A", "t1", "Sales", "1.00")


def test_semantic_search(catalogue):
    sheets, files, policies = catalogue
    hits = [x.sheet_id for x in r.semantic_search(sheets, files, [1.0, 0.0]).collect()]
    assert hits == ["s1", "s3", "s2"]
    assert [x.sheet_id for x in r.semantic_search(sheets, files, [1.0, 0.0], 0.999).collect()] == ["s1", "s3"]
    mine = r.semantic_search(sheets, files, [1.0, 0.0], policies=policies, role="Analyst")
    assert [x.sheet_id for x in mine.collect()] == ["s1", "s2"]
    assert r.semantic_search(sheets, files, [1.0, 0.0], limit=51).count() == len(hits)


def test_metadata_questions(spark):
    texts = ["Which file has it", "  WHERE IS x", "what was", "Show which file", "source of y"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, q string").orderBy("i")
    assert [x.m for x in df.select(r.is_metadata_question(F.col("q")).alias("m")).collect()] == [True, True, False, False, True]


@pytest.mark.parametrize("value_type, values", [("double", [0.0, None, 5.0]), ("string", ["0", None, "0.0"])])
def test_meaningful_results(spark, value_type, values):
    candidates = spark.createDataFrame([(1, i) for i in range(1, 6)], "q int, rank int")
    cells = [(1, 2, values[0]), (1, 3, values[1]), (1, 4, values[2]), (1, 5, values[0]), (1, 5, values[0])]
    df = spark.createDataFrame(cells, f"q int, rank int, v {value_type}")
    quality = r.candidate_quality(candidates, df, ["q"], "rank", "v")
    assert {x["rank"]: x.meaningful for x in quality.collect()} == {1: False, 2: False, 3: False, 4: True, 5: True}
    assert tuple(r.best_candidate(quality, ["q"], "rank").first()) == (1, 4, True)
    assert tuple(r.best_candidate(quality.where("rank < 4"), ["q"], "rank").first()) == (1, 1, False)
