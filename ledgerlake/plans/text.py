"""Text queries: chunks, pages, paragraphs, entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import embed_text
from ..operators import warehouse
from ..operators.profile import paged_file_summary, word_table_summary
from ..session import new_path
from ..sources.tables import append_chunks
from .names import sheet_heads
from .registry import query
from .views import oracle, table, view

CHUNK_SQL = """
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, replace(substr(text, CAST(i * 900 + 1 AS BIGINT), 1000), chr(0), '') AS chunk_text
FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 899) // 900)) AS i FROM documents)
"""


@query("chunk_chars", CHUNK_SQL)
def chunk_chars(spark: SparkSession, d: str) -> DataFrame:
    return tx.chunk_rows(table(spark, d, "documents", heavy=True), tx.fixed_chunks(F.col("text")), ["doc_id"])


# The oracle walks the paragraphs of all texts side by side, one step of the recursion per paragraph.
PARAGRAPH_CTES = r"""
WITH parts AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, '\n\s*\n'),
    lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps FROM paras_v),
walk(doc_id, i, cur, closed) AS (
  SELECT doc_id, 1, ps[1], CAST(NULL AS VARCHAR) FROM parts WHERE len(ps) > 0
  UNION ALL
  SELECT w.doc_id, w.i + 1,
    CASE WHEN length(w.cur) + length(p.ps[w.i + 1]) > 1000
      THEN (CASE WHEN len(regexp_split_to_array(w.cur, '\s+')) > 200
              THEN array_to_string(regexp_split_to_array(w.cur, '\s+')[-200:], ' ') ELSE w.cur END) || chr(10) || chr(10) || p.ps[w.i + 1]
      ELSE w.cur || chr(10) || chr(10) || p.ps[w.i + 1] END,
    CASE WHEN length(w.cur) + length(p.ps[w.i + 1]) > 1000 THEN w.cur END
  FROM walk w JOIN parts p ON p.doc_id = w.doc_id WHERE w.i < len(p.ps)),
chunks AS (
  SELECT doc_id, i, closed AS chunk_text FROM walk WHERE closed IS NOT NULL
  UNION ALL SELECT w.doc_id, w.i + 1, w.cur FROM walk w JOIN parts p ON p.doc_id = w.doc_id WHERE w.i = len(p.ps)),
numbered AS (SELECT doc_id, CAST(ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, chunk_text
  FROM chunks)
"""


@query("chunk_paragraphs", oracle("paras_v", recursive=True, body=PARAGRAPH_CTES + " SELECT * FROM numbered"))
def chunk_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return tx.paragraph_chunk_rows(view(spark, d, "paras_v", heavy=True), "t", ["doc_id"])


@query("pages_rows", r"""
SELECT doc_id, page_number, page_text FROM (
  SELECT doc_id, i AS page_number, regexp_replace(lines[i], '^\s+|\s+$', '', 'g') AS page_text
  FROM (SELECT doc_id, lines, CAST(unnest(range(1, len(lines) + 1)) AS INTEGER) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)))
WHERE page_text <> ''
""")
def pages_rows(spark: SparkSession, d: str) -> DataFrame:
    return tx.pages_to_rows(_paged(spark, d), "pages", ["doc_id"])


def _paged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", heavy=True).select(
        "doc_id", F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("file_name"),
        F.split("text", "\n", -1).alias("pages"),
    )


@query("para_join", r"""
SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)),
  lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10) || chr(10)) AS text FROM documents
""")
def para_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", heavy=True).select(
        "doc_id", tx.paragraphs_to_text(F.split("text", "\n", -1)).alias("text")
    )


@query("file_summary", r"""
WITH p AS (SELECT doc_id, file_name, page_number, page_text FROM (
  SELECT doc_id, file_name, i AS page_number, regexp_replace(lines[i], '^\s+|\s+$', '', 'g') AS page_text
  FROM (SELECT doc_id, file_name, lines, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT doc_id, source || '_' || CAST(doc_id AS VARCHAR) || '.pdf' AS file_name,
                string_split(text, chr(10)) AS lines FROM documents)))
  WHERE page_text <> ''),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY page_number) AS rn FROM p)
SELECT doc_id, file_name, COUNT(*) AS num_pages, 'PDF Document ''' || file_name || ''' containing ' || CAST(COUNT(*) AS VARCHAR)
  || ' pages. Preview: ' || substr(string_agg(page_text, ' ' ORDER BY rn) FILTER (rn <= 3), 1, 200) || '...' AS summary,
  'PDF, ' || file_name || ', Document' AS keywords
FROM r GROUP BY doc_id, file_name
""")
def file_summary(spark: SparkSession, d: str) -> DataFrame:
    pages = tx.pages_to_rows(_paged(spark, d), "pages", ["doc_id", "file_name"])
    return paged_file_summary(pages, "doc_id", "file_name")


@query("word_table_summary", oracle("sheet_columns_v", body="""
WITH ranked AS (SELECT sheet, name, ROW_NUMBER() OVER (PARTITION BY sheet ORDER BY position) AS rn FROM sheet_columns_v)
SELECT sheet, 'Table ' || sheet || ' with columns: ' || string_agg(name, ', ' ORDER BY rn) AS summary
FROM ranked WHERE rn <= 5 GROUP BY 1
"""))
def word_tables(spark: SparkSession, d: str) -> DataFrame:
    heads = sheet_heads(view(spark, d, "sheet_columns_v"), 5)
    return heads.select("sheet", word_table_summary(F.col("sheet"), F.col("columns")).alias("summary"))


# Entities -----------------------------------------------------------------

def _listed(name: str, patterns, flags: str = "", group: int = 0) -> str:
    parts = [f"regexp_extract_all({name}, '{flags}{p}', {group})" for p in patterns]
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


def entity_sql(name: str) -> dict[str, str]:
    return {
        "amounts": _listed(name, tx.AMOUNT_PATTERNS, "(?i)"),
        "dates": _listed(name, tx.DATE_PATTERNS, "(?i)"),
        "percentages": _listed(name, (tx.PERCENT_PATTERN,)),
        "companies": _listed(name, (tx.COMPANY_PATTERN,), "", 1),
    }


def _entity_oracle(kind: str) -> str:
    return oracle("notes_v", body=f"SELECT id, array_to_string({entity_sql('t')[kind]}, '|') AS found FROM notes_v")


@query("entities_amounts", _entity_oracle("amounts"))
def entities_amounts(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "notes_v", heavy=True).select("id", F.array_join(tx.amounts(F.col("t")), "|").alias("found"))


@query("entities_no_digits", oracle("commas_v", body=f"SELECT id, array_to_string({entity_sql('t')['amounts']}, '|') AS found FROM commas_v"))
def entities_no_digits(spark: SparkSession, d: str) -> DataFrame:
    """Texts with commas and no digit."""
    return view(spark, d, "commas_v").select("id", F.array_join(tx.amounts(F.col("t")), "|").alias("found"))


@query("entities_dates", _entity_oracle("dates"))
def entities_dates(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "notes_v", heavy=True).select("id", F.array_join(tx.dates(F.col("t")), "|").alias("found"))


@query("entities_pct", _entity_oracle("percentages"))
def entities_pct(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "notes_v", heavy=True).select("id", F.array_join(tx.percentages(F.col("t")), "|").alias("found"))


@query("entities_companies", _entity_oracle("companies"))
def entities_companies(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "notes_v", heavy=True).select("id", F.array_join(tx.companies(F.col("t")), "|").alias("found"))


@query("entities_all", f"""
WITH c AS ({CHUNK_SQL})
SELECT doc_id, chunk_index, """ + ", ".join(
    f"array_to_string({sql}, '|') AS {k}" for k, sql in entity_sql("chunk_text").items()
) + " FROM c")
def entities_all(spark: SparkSession, d: str) -> DataFrame:
    chunks = tx.chunk_rows(table(spark, d, "documents", heavy=True), tx.fixed_chunks(F.col("text")), ["doc_id"])
    found = chunks.withColumn("e", tx.entities(F.col("chunk_text")))
    return found.select("doc_id", "chunk_index", *[F.array_join(f"e.{k}", "|").alias(k) for k in tx.ENTITY_KINDS])


_TOP_ENTITIES = oracle("notes_v", body="SELECT kind, value, COUNT(*) AS n FROM ("
                       + " UNION ALL ".join(f"SELECT '{k}' AS kind, unnest({sql}) AS value FROM notes_v"
                                            for k, sql in entity_sql("t").items())
                       + ") GROUP BY 1, 2 ORDER BY n DESC, kind, value LIMIT 100")


@query("entities_topk_sketched", _TOP_ENTITIES)
def entities_topk_sketched(spark: SparkSession, d: str) -> DataFrame:
    """The same rows as ``entities_topk`` from the candidates of a sketch."""
    return tx.top_entities(view(spark, d, "notes_v", heavy=True).select(tx.entities(F.col("t")).alias("entities")), 100)


@query("entities_topk", _TOP_ENTITIES)
def entities_topk(spark: SparkSession, d: str) -> DataFrame:
    found = view(spark, d, "notes_v", heavy=True).select(tx.entities(F.col("t")).alias("entities"))
    return tx.entity_counts(found).orderBy(F.col("n").desc(), "kind", "value").limit(100)


@query("embed_text")
def embed(spark: SparkSession, d: str) -> DataFrame:
    vectors = embed_text(table(spark, d, "documents", heavy=True).select("doc_id", "text"), "text", 256)
    return vectors.select("doc_id", F.size("embedding").alias("dim"), "embedding")


_LOW = "4294967295"
_SPACES = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _rotated(x: str, n: int) -> str:
    return f"((({x} << {n}) | ({x} >> {32 - n})) & {_LOW})"


def _times(x: str, n: int) -> str:
    return f"(({x} * {n}::UBIGINT) & {_LOW})"


def _mixed(words: str) -> str:
    """Each word of a list times one constant, rotated, times the other."""
    first = f"list_transform({words}, lambda x: {_times('x', 0xCC9E2D51)})"
    return f"list_transform(list_transform({first}, lambda x: {_rotated('x', 15)}), lambda x: {_times('x', 0x1B873593)})"


def _shaken(x: str, by: int) -> str:
    return f"xor({x}, {x} >> {by})"


# Murmur3 of 32 bits with seed 42 over the UTF-8 bytes of each distinct word; its low byte is the place of the word in 256.
_HASH_CTES = f"""
WITH said AS (SELECT doc_id, unnest(CASE WHEN t = '' THEN [''] WHEN rtrim(t, {_SPACES}) = '' THEN CAST([] AS VARCHAR[])
    ELSE regexp_split_to_array(rtrim(t, {_SPACES}), '[ \\t\\n\\x0B\\f\\r]') END) AS w
  FROM (SELECT doc_id, lower(COALESCE(text, '')) AS t FROM documents)),
bytes AS (SELECT w, list_transform(range(0, strlen(w)), lambda i: CAST(instr('0123456789ABCDEF', h[2 * i + 1]) * 16
    + instr('0123456789ABCDEF', h[2 * i + 2]) - 17 AS UBIGINT)) AS b FROM (SELECT DISTINCT w, hex(encode(w)) AS h FROM said)),
words AS (SELECT w, len(b) AS n, list_transform(range(0, len(b) // 4), lambda i: b[4 * i + 1] + (b[4 * i + 2] << 8)
    + (b[4 * i + 3] << 16) + (b[4 * i + 4] << 24)) AS k, COALESCE(b[len(b) // 4 * 4 + 1], 0) + (COALESCE(b[len(b) // 4 * 4 + 2], 0) << 8)
    + (COALESCE(b[len(b) // 4 * 4 + 3], 0) << 16) AS rest FROM bytes),
mixed AS (SELECT w, n, {_mixed('k')} AS k, {_mixed('[rest]')}[1] AS rest FROM words),
body AS (SELECT w, n, rest, list_reduce(list_concat([42::UBIGINT], k), lambda h, x:
    ({_rotated('xor(h, x)', 13)} * 5 + 3864292196) & {_LOW}) AS h FROM mixed),
e1 AS (SELECT w, xor(xor(h, rest), CAST(n AS UBIGINT)) AS h FROM body),
e2 AS (SELECT w, {_times(_shaken('h', 16), 0x85EBCA6B)} AS h FROM e1),
e3 AS (SELECT w, {_times(_shaken('h', 13), 0xC2B2AE35)} AS h FROM e2),
places AS (SELECT w, CAST({_shaken('h', 16)} & 255 AS INTEGER) AS place FROM e3),
counts AS (SELECT doc_id, place, COUNT(*) AS tf FROM said JOIN places USING (w) GROUP BY 1, 2),
idf AS (SELECT place, ln(((SELECT COUNT(*) FROM documents) + 1.0::DOUBLE) / (COUNT(*) + 1.0::DOUBLE)) AS idf FROM counts GROUP BY 1),
weighed AS (SELECT doc_id, place, tf * idf AS x FROM counts JOIN idf USING (place)),
unit AS (SELECT doc_id, place, CAST(x / sqrt(SUM(x * x) OVER (PARTITION BY doc_id)) AS FLOAT) AS x FROM weighed WHERE x <> 0)
"""


@query("embed_text_weights", _HASH_CTES + """
SELECT doc_id, place, CAST(round(CAST(x AS DOUBLE) * 10000) AS BIGINT) AS weight FROM unit
WHERE round(CAST(x AS DOUBLE) * 10000) <> 0 AND doc_id IN (SELECT doc_id FROM documents WHERE trim(text) <> '')
""")
def embed_weights(spark: SparkSession, d: str) -> DataFrame:
    """The components of the vectors of all documents that are not 0, in units of 0.0001."""
    vectors = embed_text(table(spark, d, "documents", heavy=True).select("doc_id", "text"), "text", 256)
    parts = vectors.select("doc_id", F.posexplode("embedding").alias("place", "x"))
    return parts.select("doc_id", "place", F.round(F.col("x").cast("double") * 10000).cast("long").alias("weight")).where("weight <> 0")


@query("pdf_chunks", r"""
WITH pages AS (
  SELECT doc_id, page_number, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS INTEGER) AS page_number
    FROM documents)),
chunks AS (SELECT *, CAST(unnest(range(0, (length(t) + 899) // 900)) AS INTEGER) AS chunk_index FROM pages WHERE t <> '')
SELECT md5(CAST(doc_id AS VARCHAR) || chr(31) || CAST(page_number AS VARCHAR) || chr(31) || CAST(chunk_index AS VARCHAR)) AS chunk_id,
  CAST(doc_id AS VARCHAR) AS file_id, 'pdf' AS kind, page_number, chunk_index, substr(t, chunk_index * 900 + 1, 1000) AS chunk_text FROM chunks
""")
def pdf_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all pages in the catalogue's shape, appended and read back."""
    rows = warehouse.page_chunks(_paged(spark, d), "pages", "doc_id")
    path = new_path(spark, "chunks")
    append_chunks(rows, path)
    return spark.read.schema(rows.schema).parquet(path).drop("entities", "embedding")
