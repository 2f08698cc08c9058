"""Line dedup with DataFrame functions only: winnowing over line hashes.

A text is the sequence of its non-blank lines, each reduced to a hash of 128 bits. The windows to look at are those of ``min_lines`` lines, and
shorter ones whose words together make a passage. In every window the smallest hash (the last of equals) is its fingerprint (Schleimer,
Wilkerson and Aiken, 2003): two equal windows share it for certain. Only fingerprints met at more than one position matter. Their positions
are joined, and around each the match is extended both ways, to all windows that hold it; equal ones meet by the hash of all their lines,
and all but the first in order of (id, position) are later repeats. Overlapping repeats make up runs of any length, and runs go.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from .exact_dedup import content_hash
from .words import WORD

SALTS = 16
_DOC = ["doc_id", "body"]


def _salt() -> Column:
    return F.pmod(F.xxhash64("doc_id", "place"), F.lit(SALTS)).cast("int").alias("salt")


def _salted(df: DataFrame) -> DataFrame:
    """``df``, once for each salt. As it grows with the data, it is never sent whole to all tasks."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")


def _lines(texts: DataFrame) -> DataFrame:
    """One row per line of each distinct (id, text): doc_id, body, place, hash, words."""
    if not texts.groupBy(*_DOC).count().where("count > 1").isEmpty():
        # Rows that repeat an id and its text give the same lines; they shrink per task.
        texts = texts.dropDuplicates(_DOC)
    rows = texts.select("doc_id", "body", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    words = F.size(F.regexp_extract_all("line", F.lit(WORD), F.lit(0)))
    return rows.select("doc_id", "body", "place", content_hash(F.col("line")).alias("hash"), words.alias("words"))


def _windows(full: DataFrame, min_lines: int, passage_words: int) -> DataFrame:
    """(doc_id, body, place, n, run, fingerprint, at, places): the windows of each line, with a fingerprint and where it lies."""
    order = Window.partitionBy(*_DOC).orderBy("place")
    ahead = [F.struct(*[F.lead(c, i).over(order).alias(c) for c in ("hash", "place", "words")]) for i in range(min_lines)]
    rows = full.select(*_DOC, "place", F.array(*ahead).alias("ahead"))
    found = []
    for n in range(1, min_lines + 1):
        part = F.slice("ahead", 1, n)
        least = F.array_min(F.transform(part, lambda x: F.struct(x["hash"].alias("hash"), (-x["place"]).alias("back"))))
        enough = F.col("ahead")[n - 1]["hash"].isNotNull()
        words = reduce(lambda a, b: a + b, [F.col("ahead")[i]["words"] for i in range(n)])
        if n < min_lines:
            enough &= words >= passage_words
        if n > 1:
            # A window whose first and last lines both are in a passage of one line less goes with these two.
            rest = [words - F.col("ahead")[i]["words"] >= passage_words for i in (0, n - 1)]
            enough &= ~(rest[0] & rest[1])
        found.append(F.when(enough, F.struct(
            F.lit(n).alias("n"), content_hash(F.concat(*[F.col("ahead")[i]["hash"] for i in range(n)])).alias("run"),
            # A fingerprint only chooses the windows to compare, so 64 bits of it do.
            F.xxhash64(F.lit(n), least["hash"]).alias("fingerprint"), (-least["back"]).alias("at"), F.transform(part, lambda x: x["place"]).alias("places"),
        )))
    return rows.select(*_DOC, "place", F.explode(F.array_compact(F.array(*found))).alias("w")).select(*_DOC, "place", "w.*", _salt())


def repeated_lines(texts: DataFrame, min_lines: int, passage_words: int) -> tuple[DataFrame, DataFrame]:
    """All lines, and the (doc_id, body, place) of those that lie in a later repeat."""
    lines = cut(_lines(texts))
    windows = cut(_windows(lines.where("words > 0"), min_lines, passage_words))
    marks = windows.groupBy("fingerprint", *_DOC, "at").agg(F.lit(1).alias("_one"))
    met = marks.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("fingerprint")
    extended = windows.join(_salted(met), ["fingerprint", "salt"], "left_semi")
    here = F.struct(*_DOC, "place")
    first = extended.groupBy("n", "run").agg(F.min(here).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    later = extended.join(_salted(first), ["n", "run", "salt"]).where(~here.eqNullSafe(F.col("_first")))
    return lines, later.select(*_DOC, F.explode("places").alias("place"))


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 3, passage_words: int = 50
) -> DataFrame:
    """doc_id, n_lines, n_deleted, text: one row per row of ``docs``.

    A line goes if it lies in a later run: consecutive non-blank lines, of ``min_lines`` lines or ``passage_words`` words together, that occur
    at an earlier place too, line for line. Earlier means a smaller id, or a smaller place in the same text. Shorter repeats stay, in
    however many documents: a short line or two that recur (headings, greetings, quotations) are text of their documents.
    Blank lines never go and do not interrupt a run. Lines and runs are equal when 128 bits of hash are. Lines end at line feeds; ``n_lines``
    counts blank ones too. Null text is empty, and has one blank line.
    Rows without an id come first. Of several texts of one id the order is that of a hash; rows that repeat an id and its text are one
    document and get the same result. Other columns are not read. An empty table gives an empty result.
    """
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc_id"),
                        F.col(id_col).isNull().alias("nameless"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("body", F.xxhash64("text", "nameless"))
    lines, gone = repeated_lines(texts, min_lines, passage_words)
    flags = [lines.select(*_DOC, "place", F.lit(False).alias("gone")), gone.select(*_DOC, "place", F.lit(True).alias("gone"))]
    flags = reduce(DataFrame.unionByName, flags).groupBy(*_DOC, "place").agg(F.max("gone").alias("gone"))
    flags = flags.groupBy(*_DOC).agg(F.array_sort(F.collect_list(F.struct("place", "gone"))).alias("flags")).where(
        F.exists("flags", lambda f: f["gone"])
    )
    met = texts.join(flags, _DOC, "left")
    split = F.split("text", "\n")
    kept = F.filter(F.zip_with(split, "flags", lambda line, f: F.when(~f["gone"], line)), lambda line: line.isNotNull())
    return met.select(
        F.when(~F.col("nameless"), F.col("doc_id")).alias("doc_id"), F.size(split).alias("n_lines"),
        F.coalesce(F.size(F.filter("flags", lambda f: f["gone"])), F.lit(0)).alias("n_deleted"),
        F.when(F.col("flags").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
    )
