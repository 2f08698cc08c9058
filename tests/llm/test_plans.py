"""Plans and registration of the operators."""

import importlib
import re
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from ledgerlake.llm import queries
from oracle_check import compare

SF = "/root/testdata/sf0.001"
NATIVE = ["op3_mix_sources", "op7_exact_dedup", "op10_line_dedup"]

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_against_sql(spark, name):
    assert compare(spark, SF, name) is None


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_registration():
    numbers = [int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries()) and set(queries.ORACLE) <= set(entry.oracle_sql())
    assert len(corpus_pipeline.STAGES) == 5


def test_entry_without_the_subpackage(monkeypatch):
    """The rest is importable when the subpackage and the pipeline are gone."""
    for name in [n for n in sys.modules if n.startswith(("ledgerlake.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name in ("corpus_pipeline", "ledgerlake.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    bare = importlib.import_module("__spark_entry__")
    assert bare.queries() and not any(q.startswith("op") for q in bare.queries())
