"""Search queries and the choice of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import wrong_dims
from ..operators import answers, clusters
from ..operators import policy as p
from ..operators import retrieval as r
from ..session import new_path
from .registry import query
from .views import oracle, table, view

ROLE = "Analyst"
QUESTION = "_report_1"

# The request vector is the rounded mean of all vectors, the many vectors are the means per label.
MEAN_CTES = """
WITH parts AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
q AS (SELECT list(x ORDER BY i) AS v FROM (SELECT i, round(avg(x::DOUBLE), 4) AS x FROM parts GROUP BY 1)),
qs AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, round(avg(x::DOUBLE), 4) AS x FROM parts GROUP BY 1, 2) GROUP BY 1)
"""
_DIST = "list_cosine_distance(CAST({a} AS DOUBLE[]), {b})"


def _mean_vectors(spark: SparkSession, d: str, by: list[str]) -> list:
    """Rounded mean vectors; one short row per group reaches the driver, as a request would."""
    emb = table(spark, d, "embeddings")
    parts = emb.select(*by, F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy(*by, "i").agg(F.round(F.avg(F.col("x").cast("double")), 4).alias("x"))
    return (
        means.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
        .select(*by, F.col("v.x").alias("v")).collect()
    )


def _request(spark: SparkSession, d: str) -> list[float]:
    return list(_mean_vectors(spark, d, [])[0]["v"])


_TOPK = MEAN_CTES + f"""
SELECT query_id, vec_id, ROUND(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM (
  SELECT CAST(qs.label AS VARCHAR) AS query_id, e.vec_id, {_DIST.format(a='e.embedding', b='qs.v')} AS distance,
    ROW_NUMBER() OVER (PARTITION BY qs.label ORDER BY {_DIST.format(a='e.embedding', b='qs.v')}, e.vec_id) AS rank
  FROM embeddings e, qs) WHERE rank <= 5
"""


@query("vector_topk_clustered", _TOPK)
def vector_topk_clustered(spark: SparkSession, d: str) -> DataFrame:
    """The same rows as ``vector_topk`` from stored clusters."""
    queries = {str(row["label"]): list(row["v"]) for row in _mean_vectors(spark, d, ["label"])}
    made = clusters.build(table(spark, d, "embeddings"), "embedding", "vec_id", new_path(spark, "vectors"), 64)
    return made.nearest(queries, 5).withColumn("distance", F.round("distance", 6))


@query("vector_topk", _TOPK)
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    queries = {str(row["label"]): list(row["v"]) for row in _mean_vectors(spark, d, ["label"])}
    out = r.nearest_many(table(spark, d, "embeddings"), "embedding", "vec_id", queries, 5)
    return out.withColumn("distance", F.round("distance", 6))


@query("vector_nearest", MEAN_CTES + f"""
SELECT vec_id, label, ROUND({_DIST.format(a='embedding', b='q.v')}, 6) AS distance FROM embeddings, q
ORDER BY {_DIST.format(a='embedding', b='q.v')}, vec_id LIMIT 10
""")
def vector_nearest(spark: SparkSession, d: str) -> DataFrame:
    out = r.nearest(table(spark, d, "embeddings"), "embedding", _request(spark, d), 10, ["vec_id"])
    return out.select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query("vector_dims", """
SELECT dim, COUNT(*) AS n_rows FROM (SELECT len(CASE WHEN vec_id % 5 = 0 THEN embedding[:1 + vec_id % 7] ELSE embedding END) AS dim
  FROM embeddings) WHERE dim <> 64 GROUP BY 1
""")
def vector_dims(spark: SparkSession, d: str) -> DataFrame:
    cutoff = F.slice("embedding", F.lit(1), (F.col("vec_id") % 7 + 1).cast("int"))
    damaged = table(spark, d, "embeddings").select(
        F.when(F.col("vec_id") % 5 == 0, cutoff).otherwise(F.col("embedding")).alias("embedding")
    )
    return wrong_dims(damaged, "embedding", 64)


_GRANT = "g.role = '{role}' AND g.allowed AND g.data_domain = s.data_domain AND g.sensitivity_level = s.sensitivity_level"
# A sheet is seen by a grant for its domain and level, or when it lacks either; a sheet seen without a grant gives sums but no rows.
_VISIBLE = f"""
visible AS (
  SELECT s.*, NOT EXISTS (SELECT 1 FROM policies_v g WHERE {_GRANT} AND NOT g.allow_aggregation) AS allow_aggregation,
    EXISTS (SELECT 1 FROM policies_v g WHERE {_GRANT} AND g.allow_raw_rows) AS allow_raw_rows
  FROM sheets_v s
  WHERE s.data_domain IS NULL OR s.sensitivity_level IS NULL OR EXISTS (SELECT 1 FROM policies_v g WHERE {_GRANT}))
"""


@query("visible_sheets", oracle("sheets_v", "policies_v", body="WITH " + _VISIBLE.format(role="Finance_Manager").strip() + """
SELECT sheet_id, file_id, data_domain, sensitivity_level, allow_aggregation, allow_raw_rows FROM visible
"""))
def visible_sheets(spark: SparkSession, d: str) -> DataFrame:
    seen = p.visible_sheets(view(spark, d, "sheets_v"), view(spark, d, "policies_v"), "Finance_Manager")
    return seen.select(
        "sheet_id", "file_id", "data_domain", "sensitivity_level", "allow_aggregation", "allow_raw_rows"
    )


_HYBRID = MEAN_CTES.strip() + "," + _VISIBLE.format(role=ROLE) + """,
ranked AS (SELECT v.*, f.file_name, CASE WHEN contains(lower(f.file_name), '{question}') THEN 0 ELSE 1 END AS name_rank,
    list_cosine_distance(CAST(v.summary_embedding AS DOUBLE[]), (SELECT v FROM q)) AS distance
  FROM visible v JOIN files_v f ON f.file_id = v.file_id)
"""


@query("hybrid_search", oracle("sheets_v", "policies_v", "files_v", body=_HYBRID.format(question=QUESTION) + """
SELECT sheet_id, file_name, name_rank, ROUND(distance, 6) AS distance, allow_aggregation, allow_raw_rows FROM ranked
ORDER BY name_rank, ranked.distance ASC NULLS LAST, sheet_id LIMIT 3
"""))
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    out = r.hybrid_search(
        view(spark, d, "sheets_v"), view(spark, d, "files_v"), view(spark, d, "policies_v"), ROLE, QUESTION,
        _request(spark, d),
    )
    return out.select(
        "sheet_id", "file_name", "name_rank", F.round("distance", 6).alias("distance"), "allow_aggregation", "allow_raw_rows"
    )


@query("answer_question", oracle("sheets_v", "policies_v", "files_v", body=_HYBRID.format(question=QUESTION) + """,
chosen AS (SELECT sheet_id, file_id, file_name FROM ranked ORDER BY name_rank, ranked.distance ASC NULLS LAST, sheet_id LIMIT 1)
SELECT c.sheet_id, c.file_name, COUNT(*) AS n_lines, CAST(SUM(CAST(l.l_quantity AS BIGINT)) AS BIGINT) AS quantity
FROM chosen c JOIN lineitem l ON 'f' || CAST(l.l_orderkey AS VARCHAR) = c.file_id GROUP BY 1, 2
"""))
def answer_question(spark: SparkSession, d: str) -> DataFrame:
    """The rows of a file are the lines of its order; the question is an audited sum over the best candidate's rows."""
    found = r.hybrid_search(
        view(spark, d, "sheets_v"), view(spark, d, "files_v"), view(spark, d, "policies_v"), ROLE, QUESTION, _request(spark, d),
    )
    file_of = F.concat(F.lit("f"), F.col("l_orderkey").cast("string"))
    lines = table(spark, d, "lineitem").select(file_of.alias("file_id"), F.col("l_quantity").cast("long").alias("quantity"))
    statement = "SELECT COUNT(*) AS n_lines, SUM(quantity) AS quantity FROM {table}"
    made = answers.best(answers.answer(spark, found, statement, lambda row: lines.where(F.col("file_id") == row.file_id).drop("file_id")))
    return made.result.select(
        F.lit(made.candidate.sheet_id).alias("sheet_id"), F.lit(made.candidate.file_name).alias("file_name"), "n_lines", "quantity")


@query("semantic_search", oracle("sheets_v", "files_v", body=MEAN_CTES + """
SELECT file_name, sheet_id, sheet_name, summary, ROUND(similarity, 6) AS similarity FROM (
  SELECT f.file_name, s.sheet_id, s.sheet_name, s.summary,
    1 - list_cosine_distance(CAST(s.summary_embedding AS DOUBLE[]), (SELECT v FROM q)) AS similarity
  FROM sheets_v s JOIN files_v f ON f.file_id = s.file_id) t
WHERE t.similarity > 0.1 ORDER BY t.similarity DESC, sheet_id LIMIT 10
"""))
def semantic_search(spark: SparkSession, d: str) -> DataFrame:
    out = r.semantic_search(view(spark, d, "sheets_v"), view(spark, d, "files_v"), _request(spark, d), 0.1, 10)
    return out.select("file_name", "sheet_id", "sheet_name", "summary", F.round("similarity", 6).alias("similarity"))


@query("metadata_answer", oracle("sheets_v", "policies_v", "files_v", body=_HYBRID.format(question="urgent") + """
SELECT file_name, sheet_name, table_name, category, printf('%.2f', 1 - distance) AS confidence FROM ranked
ORDER BY name_rank, ranked.distance ASC NULLS LAST, sheet_id LIMIT 1
"""))
def metadata_answer(spark: SparkSession, d: str) -> DataFrame:
    return r.metadata_answer(
        view(spark, d, "sheets_v"), view(spark, d, "files_v"), view(spark, d, "policies_v"), ROLE, "urgent",
        _request(spark, d),
    )


@query("is_metadata_question", oracle("questions_v", body=r"""
SELECT conv_id, turn, regexp_matches(lower(trim(q)), '^(which file|what file|which sheet|what sheet|where is|source of)') AS is_metadata
FROM questions_v
"""))
def is_metadata_question(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "questions_v").select(
        "conv_id", "turn", r.is_metadata_question(F.col("q")).alias("is_metadata")
    )


_QUALITY = """
WITH candidates AS (SELECT DISTINCT question, rank FROM answers_v),
cells AS (SELECT question, rank, value FROM answers_v WHERE flag <> 'R'),
shape AS (SELECT question, rank, COUNT(*) AS n, COUNT(*) FILTER (value <> 0) AS filled FROM cells GROUP BY 1, 2),
quality AS (SELECT c.question, c.rank, COALESCE(s.n, 0) AS n_cells,
  COALESCE(s.n, 0) > 1 OR (COALESCE(s.n, 0) = 1 AND s.filled = 1) AS meaningful
  FROM candidates c LEFT JOIN shape s ON s.question = c.question AND s.rank = c.rank)
"""


def _quality(spark: SparkSession, d: str) -> DataFrame:
    found = view(spark, d, "answers_v")
    candidates = found.select("question", "rank").distinct()
    return r.candidate_quality(candidates, found.where("flag <> 'R'"), ["question"], "rank", "value")


@query("is_meaningful", oracle("answers_v", body=_QUALITY + " SELECT question, rank, n_cells, meaningful FROM quality"))
def is_meaningful(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d).select("question", "rank", "n_cells", "meaningful")


@query("best_candidate", oracle("answers_v", body=_QUALITY + """
SELECT question, rank AS best_rank, meaningful FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY question ORDER BY meaningful DESC, rank) AS rn FROM quality) WHERE rn = 1
"""))
def best_candidate(spark: SparkSession, d: str) -> DataFrame:
    return r.best_candidate(_quality(spark, d), ["question"], "rank")


# Policies -----------------------------------------------------------------

@query("check_permission", oracle("requests_v", "policies_v", body="""
SELECT r.event_id, COALESCE(p.allowed, false) AS allowed, COALESCE(p.allow_aggregation, false) AS allow_aggregation,
  COALESCE(p.allow_raw_rows, false) AS allow_raw_rows,
  CASE WHEN p.role IS NULL THEN 'No policy found for ' || r.role || ' accessing ' || r.data_domain || '/' || r.sensitivity_level
    WHEN p.allowed THEN 'Access allowed' ELSE 'Access denied' END AS message
FROM requests_v r LEFT JOIN policies_v p ON p.role = r.role AND p.data_domain = r.data_domain AND p.sensitivity_level = r.sensitivity_level
"""))
def check_permission(spark: SparkSession, d: str) -> DataFrame:
    out = p.check_permission(view(spark, d, "requests_v"), view(spark, d, "policies_v"))
    return out.select("event_id", *p.FLAGS, "message")


@query("role_policies", oracle("grants_v", body="""
SELECT data_domain, sensitivity_level, allowed, allow_aggregation, allow_raw_rows, COUNT(*) OVER () AS total_policies
FROM grants_v WHERE role = 'role_7' ORDER BY 1, 2
"""))
def role_policies(spark: SparkSession, d: str) -> DataFrame:
    return p.role_policies(view(spark, d, "grants_v"), "role_7")


@query("policy_seed", oracle("grants_v", "policies_v", body="""
SELECT 'kept' AS step, * FROM grants_v
UNION ALL SELECT 'seeded', * FROM policies_v WHERE NOT EXISTS (SELECT 1 FROM grants_v WHERE role = 'nobody')
"""))
def policy_seed(spark: SparkSession, d: str) -> DataFrame:
    """A filled policy table stays as it is; an empty one (no grants of 'nobody') gets the seed."""
    grants = view(spark, d, "grants_v")
    kept = p.seed_if_empty(grants).select(F.lit("kept").alias("step"), "*")
    return kept.unionByName(p.seed_if_empty(grants.where("role = 'nobody'")).select(F.lit("seeded").alias("step"), "*"))


@query("duplicate_policies", oracle("requests_v", body="""
SELECT role, data_domain, sensitivity_level, COUNT(*) AS n FROM requests_v GROUP BY 1, 2, 3 HAVING COUNT(*) > 1
"""))
def duplicate_policies(spark: SparkSession, d: str) -> DataFrame:
    return p.duplicate_policies(view(spark, d, "requests_v"))


@query("audit_sql", oracle("sql_log_v", body=r"""
SELECT id, allow_raw OR (NOT row_level AND agg) AS valid,
  CASE WHEN allow_raw THEN 'raw' WHEN NOT row_level AND agg THEN 'aggregated' END AS access_level,
  CASE WHEN allow_raw THEN 'ok' WHEN row_level THEN 'raw rows not allowed' WHEN NOT agg THEN 'aggregation required' ELSE 'ok' END AS reason
FROM (SELECT id, allow_raw, regexp_matches(lower(sql_query), 'select\s+\*|limit|offset') AS row_level,
  regexp_matches(lower(sql_query), 'sum\(|avg\(|count\(|max\(|min\(|group\s+by') AS agg FROM sql_log_v)
"""))
def audit_sql(spark: SparkSession, d: str) -> DataFrame:
    return p.audit_sql(view(spark, d, "sql_log_v")).select("id", "valid", "access_level", "reason")


@query("audit_sql_strict", oracle("sql_log_v", body=r"""
SELECT id, allow_raw OR (NOT row_level AND agg) AS valid FROM (
  SELECT id, allow_raw, regexp_matches(lower(sql_query), '\bselect\s+\*|\blimit\b|\boffset\b') AS row_level,
    regexp_matches(lower(sql_query), '\b(sum|avg|count|max|min)\s*\(|\bgroup\s+by\b') AS agg FROM sql_log_v)
"""))
def audit_sql_strict(spark: SparkSession, d: str) -> DataFrame:
    return p.audit_sql(view(spark, d, "sql_log_v"), strict=True).select("id", "valid")
