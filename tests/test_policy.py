import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import policy as p


def test_visibility(spark):
    sheets = spark.createDataFrame(
        [("null_domain", None, "confidential"), ("null_level", "hr", None), ("finance", "finance", "confidential"),
         ("hr", "hr", "confidential"), ("general", "general", "internal")],
        "sheet_id string, data_domain string, sensitivity_level string")
    seed = p.seed(spark)
    see = lambda role: {r.sheet_id: (r.allow_aggregation, r.allow_raw_rows)
                        for r in p.visible_sheets(sheets, seed, role).collect()}
    common = {"null_domain": (True, False), "null_level": (True, False)}
    assert see("CEO") == common | {"finance": (True, True), "hr": (True, True)}
    assert see("Finance_Manager") == common | {"finance": (True, True)}
    assert see("Analyst") == common | {"finance": (True, False)}
    assert see("Guest") == common


def test_permissions(spark):
    asks = spark.createDataFrame(
        [("CEO", "hr", "confidential"), ("Finance_Manager", "hr", "confidential"), ("Guest", "hr", "internal")],
        "role string, data_domain string, sensitivity_level string")
    got = {r.role: (r.allowed, r.allow_raw_rows, r.message) for r in p.check_permission(asks, p.seed(spark)).collect()}
    assert got == {"CEO": (True, True, "Access allowed"), "Finance_Manager": (False, False, "Access denied"),
                   "Guest": (False, False, "No policy found for Guest accessing hr/internal")}


def test_seed_and_lists(spark):
    seed = p.seed(spark)
    assert p.seed_if_empty(seed.where("false")).count() == 6
    assert p.seed_if_empty(seed.limit(2)).count() == 2
    rows = p.role_policies(seed, "CEO").collect()
    assert [(r.data_domain, r.total_policies) for r in rows] == [("finance", 2), ("hr", 2)]
    assert p.require_unique(seed) is seed
    with pytest.raises(ValueError, match="more than one policy"):
        p.require_unique(seed.unionByName(seed))
    assert p.duplicate_policies(seed).count() == 0 and p.duplicate_policies(seed.unionByName(seed)).count() == 6


@pytest.mark.parametrize("sql, raw, valid, level, strict", [
    ("SELECT * FROM table", True, True, "raw", True),
    ("SELECT vendor, SUM(amount) FROM table GROUP BY vendor", False, True, "aggregated", True),
    ("SELECT COUNT(*) FROM table", False, True, "aggregated", True),
    ("SELECT * FROM table", False, False, None, False),
    ("SELECT vendor, amount FROM table", False, False, None, False),
    ("SELECT AVG(credit_limit) FROM t", False, False, None, True),
    ("SELECT checksum(x) FROM t", False, True, "aggregated", False),
    ("SELECT SUM (x) FROM t", False, False, None, True),
    ("SELECT a FROM t GROUP\n BY a OFFSET 3", False, False, None, False),
])
def test_audit(spark, sql, raw, valid, level, strict):
    df = spark.createDataFrame([(sql, raw)], "sql_query string, allow_raw boolean")
    row = p.audit_sql(df).first()
    assert (row.valid, row.access_level) == (valid, level)
    assert p.audit_sql(df, strict=True).first().valid == strict


def test_audit_gives_different_reasons(spark):
    df = spark.createDataFrame([("SELECT * FROM t",), ("SELECT a FROM t",)], "sql_query string").withColumn("allow_raw", F.lit(False))
    assert len({r.reason for r in p.audit_sql(df).collect()}) == 2
