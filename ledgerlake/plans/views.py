"""Inputs derived from the given tables, each one SELECT for Spark and the SQL oracle alike.

Every view grows with the tables it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import POLICIES, POLICY_SEED
from ..session import spread

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str] = {}

VIEWS["files_v"] = """
SELECT 'f' || CAST(o_orderkey AS VARCHAR) AS file_id,
  lower(replace(o_orderpriority, ' ', '_')) || '_report_' || CAST(o_orderkey AS VARCHAR)
    || CASE o_orderkey % 7 WHEN 0 THEN '.xlsx' WHEN 1 THEN '.CSV' WHEN 2 THEN '.pdf' WHEN 3 THEN '.txt'
       WHEN 4 THEN '.docx' WHEN 5 THEN '.tar.gz' ELSE '' END AS file_name,
  o_orderdate AS uploaded_at,
  CAST(o_orderkey % 4 AS INTEGER) AS num_sheets,
  CAST(CASE WHEN o_orderkey % 7 = 2 THEN o_custkey % 30 END AS INTEGER) AS num_pages,
  'Customer ' || CAST(o_custkey AS VARCHAR) AS summary,
  o_orderstatus || ', ' || o_orderpriority AS keywords,
  md5(CAST(o_custkey AS VARCHAR)) AS file_hash,
  CAST(o_totalprice * 400 AS BIGINT) AS length
FROM {orders}
"""

VIEWS["sheets_v"] = """
SELECT 's' || CAST(vec_id AS VARCHAR) AS sheet_id,
  CASE WHEN vec_id % 41 = 40 THEN 'gone' || CAST(vec_id AS VARCHAR)
    ELSE 'f' || CAST(CASE WHEN vec_id % 3 = 0 THEN 7 ELSE vec_id END AS VARCHAR) END AS file_id,
  'Sheet ' || CAST(vec_id AS VARCHAR) AS sheet_name,
  'sheet_' || CAST(vec_id AS VARCHAR) AS table_name,
  CASE WHEN vec_id % 13 = 0 THEN NULL ELSE vec_id % 97 END AS num_rows,
  CAST(1 + vec_id % 12 AS INTEGER) AS num_columns,
  CASE WHEN vec_id % 5 = 0 THEN NULL ELSE 'Cat ' || CAST(label AS VARCHAR) END AS category,
  'Label ' || CAST(label AS VARCHAR) AS summary,
  'k' || CAST(vec_id % 9 AS VARCHAR) AS keywords,
  CASE vec_id % 4 WHEN 0 THEN 'finance' WHEN 1 THEN 'hr' WHEN 2 THEN 'general' ELSE NULL END AS data_domain,
  CASE vec_id % 3 WHEN 0 THEN 'confidential' WHEN 1 THEN 'internal' ELSE NULL END AS sensitivity_level,
  CASE WHEN vec_id % 50 = 49 THEN NULL ELSE embedding END AS summary_embedding
FROM {embeddings}
"""

VIEWS["chunks_v"] = """
SELECT 'c' || CAST(doc_id AS VARCHAR) AS chunk_id,
  CASE WHEN doc_id % 37 = 36 THEN 'gone' || CAST(doc_id AS VARCHAR) ELSE 'f' || CAST(doc_id AS VARCHAR) END AS file_id,
  CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'text' ELSE 'word' END AS kind, text AS chunk_text
FROM {documents}
"""

VIEWS["policies_v"] = "SELECT * FROM (VALUES {}) AS t({})".format(
    ", ".join("({})".format(", ".join(str(v).lower() if isinstance(v, bool) else f"'{v}'" for v in row)) for row in POLICY_SEED),
    ", ".join(POLICIES.names),
)

VIEWS["grants_v"] = """
SELECT 'role_' || CAST(c_nationkey AS VARCHAR) AS role, lower(c_mktsegment) AS data_domain,
  'level_' || CAST(c_custkey AS VARCHAR) AS sensitivity_level, c_acctbal > 0 AS allowed,
  c_acctbal > 1000 AS allow_aggregation, c_acctbal > 5000 AS allow_raw_rows
FROM {customer}
"""

VIEWS["requests_v"] = """
SELECT event_id, CASE user_id % 5 WHEN 0 THEN 'CEO' WHEN 1 THEN 'Finance_Manager' WHEN 2 THEN 'Analyst'
    WHEN 3 THEN 'Employee' ELSE 'Guest' END AS role,
  CASE event_id % 3 WHEN 0 THEN 'finance' WHEN 1 THEN 'hr' ELSE 'general' END AS data_domain,
  CASE event_id % 2 WHEN 0 THEN 'confidential' ELSE 'internal' END AS sensitivity_level
FROM {events}
"""

VIEWS["grid_v"] = """
SELECT 'sh' || CAST(CAST(FLOOR(l_orderkey / 30.0) AS BIGINT) AS VARCHAR) AS sheet,
  CAST(l_partkey % 40 AS BIGINT) AS r, CAST(l_suppkey % 12 AS BIGINT) AS c,
  CAST(CAST(MAX(l_quantity) AS BIGINT) AS VARCHAR) AS value
FROM {lineitem} GROUP BY 1, 2, 3
"""

# As grid_v, with words for headers, and columns of words, decimals and whole numbers.
VIEWS["mixed_v"] = """
SELECT 'Sheet ' || CAST(CAST(FLOOR(l_orderkey / 30.0) AS BIGINT) AS VARCHAR) AS sheet,
  CAST(l_partkey % 40 AS BIGINT) AS r, CAST(l_suppkey % 12 AS BIGINT) AS c,
  CASE WHEN l_partkey % 40 % 6 = 0 THEN CASE l_suppkey % 12 % 4 WHEN 0 THEN 'Net Sales' WHEN 1 THEN 'Region' WHEN 2 THEN 'Order' ELSE '2024 Cost' END
    WHEN l_suppkey % 12 % 3 = 0 THEN CAST(CAST(MAX(l_quantity) AS BIGINT) AS VARCHAR) || '.5'
    WHEN l_suppkey % 12 % 3 = 1 THEN 'item ' || CAST(CAST(MAX(l_quantity) AS BIGINT) AS VARCHAR)
    ELSE CAST(CAST(MAX(l_quantity) AS BIGINT) AS VARCHAR) END AS value
FROM {lineitem} GROUP BY 1, 2, 3, l_partkey % 40 % 6, l_suppkey % 12 % 4, l_suppkey % 12 % 3
"""

VIEWS["ledger_v"] = """
SELECT l_suppkey AS k, l_orderkey AS k_small, l_linenumber AS seq, l_partkey AS tie, l_shipdate AS ts,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS revenue,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(CASE l_suppkey % 5 WHEN 0 THEN 1.05 WHEN 1 THEN 0.92 ELSE 0.60 END
       AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS cost FROM {lineitem}
"""

VIEWS["money_text_v"] = """
SELECT o_orderkey AS id, CASE o_orderkey % 6
  WHEN 0 THEN '$' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)
  WHEN 1 THEN 'USD ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)
  WHEN 2 THEN '(' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || ')'
  WHEN 3 THEN 'n/a' WHEN 4 THEN NULL ELSE '1-2-3' END AS raw FROM {orders}
"""

VIEWS["date_text_v"] = """
SELECT o_orderkey AS id, substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS iso,
  CASE o_orderkey % 6
  WHEN 0 THEN substr(CAST(o_orderdate AS VARCHAR), 1, 10)
  WHEN 1 THEN substr(CAST(o_orderdate AS VARCHAR), 6, 2) || '/' || substr(CAST(o_orderdate AS VARCHAR), 9, 2)
    || '/' || substr(CAST(o_orderdate AS VARCHAR), 1, 4)
  WHEN 2 THEN 'Mar ' || substr(CAST(o_orderdate AS VARCHAR), 9, 2) || ', ' || substr(CAST(o_orderdate AS VARCHAR), 1, 4)
  WHEN 3 THEN substr(CAST(o_orderdate AS VARCHAR), 1, 4)
  WHEN 4 THEN 'soon' ELSE NULL END AS raw FROM {orders}
"""

VIEWS["notes_v"] = """
SELECT o_orderkey AS id, 'Invoice for Blue River Trading Corp dated ' || SUBSTR(CAST(o_orderdate AS VARCHAR),1,10) ||
  ', total $' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || ' or Rs. ' || CAST(o_custkey AS VARCHAR) ||
  ', discount ' || CAST(o_orderkey % 30 AS VARCHAR) || '% due 1/2/2024 (Jan 5, 2024) from Acme Steel Ltd' AS t FROM {orders}
"""

VIEWS["commas_v"] = """
SELECT c_custkey AS id, c_mktsegment || ' customers, suppliers and cars, price in $, please; usd ,, or INR, or ' ||
  CASE c_nationkey % 3 WHEN 0 THEN '£ ,' WHEN 1 THEN '€,' ELSE 'nothing' END AS t FROM {customer}
"""

VIEWS["paras_v"] = """
SELECT doc_id, REPLACE(text, chr(10), chr(10) || chr(10)) AS t FROM {documents}
"""

VIEWS["versions_v"] = """
SELECT 'u' || CAST(user_id AS VARCHAR) AS file_name, event_id AS arrival, md5(event_type) AS file_hash FROM {events}
"""

VIEWS["sql_log_v"] = """
SELECT o_orderkey AS id, o_orderkey % 3 = 0 AS allow_raw, CASE o_orderkey % 7
  WHEN 0 THEN 'SELECT * FROM t' WHEN 1 THEN 'SELECT vendor, SUM(amount) FROM t GROUP BY vendor'
  WHEN 2 THEN 'SELECT vendor, amount FROM t' WHEN 3 THEN 'SELECT COUNT(*) FROM t'
  WHEN 4 THEN 'SELECT sum(x) FROM t ORDER BY 1 LIMIT 5' WHEN 5 THEN 'SELECT avg(credit_limit) FROM t'
  ELSE 'SELECT a FROM t GROUP  BY a' END AS sql_query FROM {orders}
"""

VIEWS["questions_v"] = """
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Which file has ' WHEN 1 THEN '  Where is ' ELSE 'What was ' END || text AS q
  FROM {conversations}
"""

VIEWS["headers_v"] = """
SELECT p_partkey AS id, CAST(FLOOR(p_partkey / 40.0) AS BIGINT) AS table_id,
  CASE WHEN p_partkey % 20 = 3 THEN 'Unnamed 2' WHEN p_partkey % 40 = 5 THEN 'unnamed-4' ELSE CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'Order' WHEN 2 THEN '2024 ' || p_name
  WHEN 3 THEN p_brand || ' (' || p_type || ')' WHEN 4 THEN '__' || p_name || '__' WHEN 5 THEN NULL ELSE '###' END END AS name
  FROM {part}
"""

VIEWS["columns_v"] = """
SELECT p_partkey AS id, lower(p_name) || CASE p_partkey % 11 WHEN 0 THEN '_revenue' WHEN 1 THEN ' cost' WHEN 2 THEN '_date'
    WHEN 3 THEN '_id' WHEN 4 THEN ' margin' WHEN 5 THEN '_total' WHEN 6 THEN '_jan_2024' WHEN 7 THEN ' vendor'
    WHEN 8 THEN '_holiday' WHEN 9 THEN ' num_items' ELSE '' END AS name,
  CASE p_size % 4 WHEN 0 THEN 'TEXT' WHEN 1 THEN 'INTEGER' WHEN 2 THEN 'DOUBLE PRECISION' ELSE 'TIMESTAMP' END AS type
FROM {part}
"""

VIEWS["sheet_columns_v"] = """
SELECT p_brand AS sheet, p_partkey AS position, replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR) AS name,
  p_name AS original_name, p_type AS sample, p_size AS num_rows
FROM {part}
"""

VIEWS["answers_v"] = """
SELECT l_orderkey AS question, l_linenumber AS rank, l_returnflag AS flag,
  CASE WHEN l_quantity < 5 THEN NULL ELSE CAST(l_discount AS DECIMAL(4,2)) END AS value
FROM {lineitem}
"""


def table(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if heavy else df


def view(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False) -> DataFrame:
    """``heavy`` shares out a small file over all cores, for work that costs much per row."""
    sql = VIEWS[name]
    used = {t: table(spark, sf_dir, t, heavy) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql.replace("VARCHAR", "STRING"), **used)


def oracle(*views: str, body: str, recursive: bool = False) -> str:
    """``body`` for the SQL oracle with the views it names as leading CTEs."""
    ctes = []
    for v in views:
        sql = VIEWS[v]
        for t in TABLES:
            sql = sql.replace("{" + t + "}", t)
        ctes.append(f"{v} AS ({sql.strip()})")
    head = "WITH " + ("RECURSIVE " if recursive else "")
    body = body.strip()
    if not ctes:
        return (head + body) if recursive else body
    if body.upper().startswith("WITH "):
        return head + ",\n".join(ctes) + ",\n" + body[5:]
    return head + ",\n".join(ctes) + "\n" + body
