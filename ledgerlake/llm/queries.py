"""The registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path
from . import exact_dedup, lexical, line_dedup, lm_score, mixing, near_dedup, packing, periodic, pieces, quality, token_files, top_k, url_filter

cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=3, per_cent=85)


@query
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = mixing.copies(table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE["op3_mix_sources"] = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS i FROM sized),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS most FROM sums),
-- Sources by the level at which each is full; with the first k of them full, the rest share what is left by weight.
levels AS (
  SELECT *, sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spent,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
    1.5::DOUBLE * sum(source_size) OVER () AS whole, row_number() OVER o AS k
  FROM ranked WINDOW o AS (ORDER BY most / weight, source NULLS LAST)),
first_open AS (
  SELECT k, whole - coalesce(spent, 0) AS to_share, rest FROM levels
  WHERE most * rest > weight * (whole - coalesce(spent, 0)) ORDER BY k LIMIT 1),
goals AS (
  SELECT source, source_size, CASE WHEN f.k IS NULL OR l.k < f.k THEN most ELSE weight * f.to_share / f.rest END AS target
  FROM levels l LEFT JOIN first_open f ON true),
rated AS (
  SELECT doc_id, size, source_size, target, i, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
    CAST(CAST('0x' || substr(md5('0:' || coalesce(p.source, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS start
  FROM placed p JOIN goals g ON p.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST((floor(i * rate + start) - floor((i - 1) * rate + start)) * size AS BIGINT) AS taken
FROM rated
"""


@query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="max")


ORACLE["op7_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, vocabulary = new_path(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json")
    chunks = token_files.encoded_chunks(table(spark, sf_dir, "documents"), lambda: token_files.shared_encoder(vocabulary), end_id=2)
    token_files.write(chunks, path)
    return token_files.documents(token_files.read(spark, path))


@query
def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE["op5_top_k"] = """
WITH sound AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM sound q JOIN sound c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


#: Given rules; they go before what is mined.
URL_RULES = [
    url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/"),
]


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and documents share their ids here: a page is bad when the document of its id is of low quality or toxic."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), bad.alias("bad"))
    return url_filter.judged(table(spark, sf_dir, "pages"), labels, URL_RULES)


def id_crc(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


@query
def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scored(table(spark, sf_dir, "documents"), id_crc() % 7 == 2)


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return quality.classified(table(spark, sf_dir, "documents"), labels, id_crc() % 3 == 1)


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeats(table(spark, sf_dir, "documents"))


ORACLE["op10_line_dedup"] = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS place FROM split),
full_lines AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS nth
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
ahead AS (
  SELECT doc_id, nth, line, words, lead(line) OVER d AS second, lead(line, 2) OVER d AS third, words + lead(words) OVER d AS words_of_two
  FROM full_lines WINDOW d AS (PARTITION BY doc_id ORDER BY nth)),
-- Three lines are a run, and so are two or one with fifty words.
runs AS (
  SELECT doc_id, nth, 3 AS n, line || chr(10) || second || chr(10) || third AS run FROM ahead WHERE third IS NOT NULL
  UNION ALL SELECT doc_id, nth, 2, line || chr(10) || second FROM ahead WHERE words_of_two >= 50
  UNION ALL SELECT doc_id, nth, 1, line FROM ahead WHERE words >= 50),
later AS (SELECT doc_id, nth, n FROM runs QUALIFY row_number() OVER (PARTITION BY n, run ORDER BY doc_id, nth) > 1),
gone AS (
  SELECT DISTINCT f.doc_id, f.place FROM full_lines f
  JOIN (SELECT doc_id, nth + unnest(range(n)) AS nth FROM later) r ON f.doc_id = r.doc_id AND f.nth = r.nth)
SELECT l.doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(g.place) AS INTEGER) AS n_deleted,
  coalesce(string_agg(l.line, chr(10) ORDER BY l.place) FILTER (g.place IS NULL), '') AS text
FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.place = g.place GROUP BY l.doc_id
"""


@query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of each text, and whether they decode to it."""
    import public_tokenizers

    model = pieces.Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    coded = pieces.encoded(table(spark, sf_dir, "documents"), model, check=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), (F.col("round_trip") & ~F.col("markers")).alias("round_trip"), "ids")


def planted(ids: list[int | None], sizes: np.ndarray) -> np.ndarray:
    """The word that stands in each word's place: every tenth document by the CRC of its id repeats a stretch from some word to its end."""
    starts = np.cumsum(sizes) - sizes
    out = np.arange(int(sizes.sum()))
    for doc_id, start, n in zip(ids, starts.tolist(), sizes.tolist(), strict=True):
        crc = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if crc % 10 == 0 and n:
            g = crc // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            out[start + a : start + n] = start + a + np.arange(n - a) % p
    return out


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without an id are taken as they are."""
    found = periodic.periodic_runs(table(spark, sf_dir, "documents"), rewrite=planted)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    length, period = longest["n"], -longest["short"]
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-longest["back"]).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(F.lit(1000) * length / period).alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    pieces_ = packing.packed(table(spark, sf_dir, "documents"), lambda: token_files.shared_encoder(vocabulary), end_id=2)
    return pieces_.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op13_lexical_search"] = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
norms AS (
  SELECT doc_id, terms, 100 - 90 + (90 * len(terms) * sum(CAST(len(terms) > 0 AS BIGINT)) OVER ()) // greatest(1, sum(len(terms)) OVER ()) AS m,
    sum(CAST(len(terms) > 0 AS BIGINT)) OVER () AS n_docs
  FROM texts),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
counted AS (
  SELECT doc_id, m, n_docs, term, count(*) AS tf FROM (SELECT doc_id, m, n_docs, unnest(terms) AS term FROM norms)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weighed AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM counted GROUP BY term),
scored AS (
  SELECT a.item_id, c.doc_id, CAST(sum(w * ((1000000000 * c.tf) // (1000 * c.tf + 8 * c.m))) AS BIGINT) AS score
  FROM asked a JOIN counted c ON a.term = c.term JOIN weighed v ON a.term = v.term GROUP BY a.item_id, c.doc_id),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""
