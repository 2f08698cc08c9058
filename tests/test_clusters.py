import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import clusters as c
from ledgerlake.session import new_path


def corpus(spark, groups, n=600, dim=8, noise=0.05):
    """Vectors around some directions, a third of them equal, and rows without a distance."""
    rnd = np.random.default_rng(5)
    middle = rnd.normal(size=(groups, dim))
    v = middle[rnd.integers(0, groups, n)] + noise * rnd.normal(size=(n, dim))
    v *= rnd.uniform(0.5, 3, size=(n, 1))
    v[100:300] = v[7]
    v = v.astype("float32")
    rows = [(i, [float(x) for x in v[i]]) for i in range(n)]
    odd = [(n, None), (n + 1, [0.0] * dim), (n + 2, [1.0]), (n + 3, [float("nan")] + [1.0] * (dim - 1)), (n + 4, [None] + [1.0] * (dim - 1)),
           (n + 5, [float("inf")] + [1.0] * (dim - 1)), (n + 6, [])]
    return v.astype("float64"), spark.createDataFrame(rows + odd, "key bigint, v array<float>").repartition(5)


def brute(v, q, k):
    d = 1 - v @ q / (np.linalg.norm(v, axis=1) * np.linalg.norm(q))
    return [int(i) for i in np.lexsort((np.arange(len(v)), np.round(d, 12)))[:k]]


def answers(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.key)
    return found


@pytest.mark.parametrize("groups", [1, 12])
def test_same_as_brute_force(spark, monkeypatch, groups):
    v, df = corpus(spark, groups)
    made = c.build(df, "v", "key", new_path(spark, "vectors"), 8, clusters=10)
    rnd = np.random.default_rng(6)
    queries = {f"q{i}": [float(x) for x in q] for i, q in enumerate([v[7], -v[7], v[400], v[599] * 50, *rnd.normal(size=(3, 8))])}
    for k in (1, 5, 250, 1000):
        got = answers(made.nearest({**queries, "zero": [0.0] * 8}, k))
        assert got == {n: brute(v, np.array(q), k) for n, q in queries.items()}
    monkeypatch.setattr(c, "QUERY_BLOCK", 2)
    assert answers(made.nearest(queries, 5)) == {n: brute(v, np.array(q), 5) for n, q in queries.items()}


def test_clusters_out_of_reach_are_not_read(spark):
    v, df = corpus(spark, 12, noise=0.02)
    made = c.build(df, "v", "key", new_path(spark, "vectors"), 8, clusters=12)
    queries = {"a": [float(x) for x in v[400]], "b": [float(x) for x in v[599]]}
    assert made.share_scored(queries, 3) < 0.5
    near, rest, _ = next(made._plans(queries, 3))
    filled = made.rows().select("cluster").distinct().count()
    assert filled > 4 and near.wanted.sum() + rest.wanted.sum() < 2 * filled
    scan = lambda plan: plan.rows(made.rows())._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cluster", scan(near))
    rest.wanted[:, 0] = True
    assert re.search(r"PartitionFilters: \[[^\]]*cluster", scan(rest)) and re.search(r"DataFilters: \[[^\]]*gap", scan(rest))


def test_odd_corpora(spark):
    _, df = corpus(spark, 2)
    for rows in (df.where("false"), df.where("key >= 600")):
        empty = c.build(rows, "v", "key", new_path(spark, "vectors"), 8)
        assert empty.nearest({"q": [1.0] * 8}, 3).count() == 0 and empty.share_scored({"q": [1.0] * 8}, 3) == 0
        assert empty.nearest({}, 3).columns == ["query_id", "key", "distance", "rank"]
    # All vectors equal, rows repeated, ids as text.
    same = spark.range(20).select((F.col("id") % 10).cast("string").alias("key"), F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    made = c.build(same, "v", "key", new_path(spark, "vectors"), 2)
    assert answers(made.nearest({"q": [2.0, 4.0]}, 4)) == {"q": ["0", "0", "1", "1"]}
    assert made.nearest({"q": [2.0, 4.0]}, 0).count() == 0
