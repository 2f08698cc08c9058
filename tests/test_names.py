import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlake.functions import names


def one(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_default_names(spark):
    values = [None, "", "order", "2024 Sales", "__x__", "Été", "Net  Amount ($)", "###"]
    assert one(spark, names.normalize_name, values) == [
        "unnamed", "unnamed", "_order", "_2024_sales", "x", "t", "net_amount", "unnamed"]


def test_csv_names(spark):
    assert one(spark, names.normalize_name_csv, [None, "Été", "a  b", "__x__", "№ 1", "Größe (m²)"]) == [
        "none", "été", "a__b", "x", "1", "größe__m²"]


def test_word_names(spark):
    assert one(spark, names.normalize_name_word, [None, "", "2024 Sales", "order", "A-B"]) == [
        "none", "col_", "col_2024_sales", "order", "a_b"]


def test_suffixes_pass_over_names_of_the_table(spark):
    rows = ["a", "a", "a_1", "a", "a_3", "a_1", "a", "b_1", "b", "b", "a_1_1", "a_1"]
    df = spark.createDataFrame([(1, p, n) for p, n in enumerate(rows)] + [(2, 0, "a"), (2, 1, "a"), (None, 0, "c"), (None, 1, "c_1"), (None, 2, "c")], "t int, p int, n string")
    out = names.dedup_names(df, ["t"], "p", "n")
    got = {(r.t, r.p): r.final_name for r in out.collect()}
    assert [got[1, p] for p in range(len(rows))] == ["a", "a_2", "a_1", "a_4", "a_3", "a_1_2", "a_5", "b_1", "b", "b_2", "a_1_1", "a_1_3"]
    assert [got[2, p] for p in range(2)] == ["a", "a_1"] and [got[None, p] for p in range(3)] == ["c", "c_1", "c_2"]
    assert names.name_collisions(out, ["t"]).count() == 0


def test_dedup_with_a_large_group(spark, tiny_groups):
    rows = [(1, p, "ab"[p % 2]) for p in range(40)]
    df = spark.createDataFrame(rows, "t int, p int, n string")
    got = {r.p: r.final_name for r in names.dedup_names(df, ["t"], "p", "n").collect()}
    assert got == {p: n if p < 2 else f"{n}_{p // 2}" for _, p, n in rows}


def test_table_names(spark):
    row = spark.range(1).select(
        names.sheet_table_name(F.lit("Q1 2024"), F.lit("ab-cdef0123-45")).alias("a"),
        names.csv_table_name(F.lit("main"), F.lit("ab-cdef0123-45")).alias("b"),
        names.word_table_name(F.lit(3), F.lit("ab-cdef0123-45")).alias("c"),
    ).first()
    assert tuple(row) == ("sheet_q1_2024_abcdef01", "data_abcdef01_main", "word_table_abcdef01_3")


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.text(alphabet=st.characters(codec="ascii"), max_size=12), min_size=1, max_size=20))
def test_default_names_by_rule(spark, values):
    def expected(v):
        s = re.sub(r"[^a-z0-9]+", "_", v.lower()).strip("_")
        if not s:
            return "unnamed"
        return "_" + s if s[0].isdigit() or s in names.RESERVED else s

    assert one(spark, names.normalize_name, values) == [expected(v) for v in values]


@pytest.mark.parametrize("word", names.RESERVED)
def test_reserved_words(spark, word):
    assert one(spark, names.normalize_name, [word.upper()]) == ["_" + word]
