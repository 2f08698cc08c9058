"""Chunks and entities of text."""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .clean import strip_nul

# The entity patterns, in the order in which their hits are listed.
AMOUNT_PATTERNS = (
    r"\$\s*[\d,]+\.?\d*",
    r"USD\s*[\d,]+\.?\d*",
    r"Rs\.?\s*[\d,]+\.?\d*",
    r"INR\s*[\d,]+\.?\d*",
    r"€\s*[\d,]+\.?\d*",
    r"£\s*[\d,]+\.?\d*",
)
CURRENCY_SIGNS = ("$", "€", "£")
DATE_PATTERNS = (
    r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}",
    r"\d{4}[/-]\d{1,2}[/-]\d{1,2}",
    r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}",
)
PERCENT_PATTERN = r"\d+\.?\d*\s*%"
COMPANY_SUFFIXES = ("Inc", "Corp", "Ltd", "LLC", "Limited", "Corporation", "Company")
COMPANY_PATTERN = rf"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){{1,3}})\s+(?:{'|'.join(COMPANY_SUFFIXES)})"
ENTITY_KINDS = ("amounts", "dates", "percentages", "companies")

_SPACE = r"(?U)[\s\x1c-\x1f]"
_BLANK_LINES = re.compile(r"\n\s*\n")
# Characters of output a task gathers before it passes them on.
_SLICE = 8_000_000

# Executors get the packing step with the task and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def strip(text: Column) -> Column:
    """Remove white space of any script at both ends."""
    return F.regexp_replace(text, rf"^{_SPACE}+|{_SPACE}+$", "")


def fixed_chunks(text: Column, size: int = 1000, overlap: int = 100) -> Column:
    """Windows of ``size`` characters every ``size - overlap``, as one array.

    One pass of the regular-expression engine walks the text: each match moves a
    step forward and its look-ahead group captures the whole window, so the cost
    grows with the text and not with text times windows.
    """
    step = size - overlap
    if step < 1:
        raise ValueError("overlap must be smaller than size")
    pattern = f"(?s)(?=(.{{1,{size}}})).{{1,{step}}}"
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), strip_nul)


def chunk_rows(df: DataFrame, chunks: Column, keep: list[str]) -> DataFrame:
    """One row per chunk: the kept columns, ``chunk_index`` from 0 and ``chunk_text``.

    The outer form with a filter behind it, as the plain form makes the optimiser
    test the size of the array first, which computes it twice.
    """
    return df.select(*keep, F.posexplode_outer(chunks).alias("chunk_index", "chunk_text")).where(
        F.col("chunk_index").isNotNull()
    )


def _packed(text: str, size: int, overlap: int) -> Iterator[str]:
    """Paragraphs of one text packed into chunks, each opening with the last words of the one before it.

    Where a chunk ends follows from sums of the paragraphs' lengths, so it is looked up and its text is cut once.
    """
    found = [p for p in (part.strip() for part in _BLANK_LINES.split(text)) if p]
    ends = list(accumulate((len(p) + 2 for p in found), initial=0))
    head, first = [], 0
    while first < len(found):
        # Paragraph ``last`` is the first that no longer fits; a break of two signs goes before each but the opening one.
        taken = sum(len(h) + 2 for h in head)
        last = max(first + 1, bisect_right(ends, size + 4 + ends[first] - taken) - 1)
        chunk = "\n\n".join(head + found[first:last])
        yield chunk
        tail = chunk.split()
        head, first = [" ".join(tail[-overlap:]) if len(tail) > overlap else chunk], last


def paragraph_chunk_rows(
    df: DataFrame, text: str, keep: list[str], size: int = 1000, overlap_words: int = 200
) -> DataFrame:
    """One row per chunk of whole paragraphs, each chunk opening with the tail of the last.

    What a chunk holds depends on the one before it, and ``aggregate`` copies all it
    has gathered at each step, which grows with the square of the text. So this runs
    as a generator over Arrow batches: one pass per text, output sent in slices.
    """
    schema = df.select(*keep).schema.add("chunk_index", T.IntegerType()).add("chunk_text", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [batch.column(k) for k in keep]
            rows: list[int] = []
            index: list[int] = []
            chunks: list[str] = []
            held = 0

            def flush() -> pa.RecordBatch:
                at = pa.array(rows, pa.int64())
                return pa.RecordBatch.from_arrays(
                    [*[k.take(at) for k in kept], pa.array(index, pa.int32()), pa.array(chunks, pa.string())],
                    names=[*keep, "chunk_index", "chunk_text"],
                )

            for row, value in enumerate(batch.column(text)):
                for i, chunk in enumerate(_packed(value.as_py() or "", size, overlap_words)):
                    rows.append(row)
                    index.append(i)
                    chunks.append(chunk)
                    held += len(chunk)
                    if held >= _SLICE:
                        yield flush()
                        rows, index, chunks, held = [], [], [], 0
            if rows:
                yield flush()

    columns = list(dict.fromkeys([*keep, text]))
    return df.select(*columns).mapInArrow(run, schema)


def _found(text: Column, patterns, flags: str, group: int = 0) -> Column:
    hits = [F.regexp_extract_all(text, F.lit(flags + p), F.lit(group)) for p in patterns]
    return F.concat(*hits) if len(hits) > 1 else hits[0]


def _if(possible: Column, found: Column) -> Column:
    """``found`` where the text can hold a hit at all; the test is far cheaper than the patterns."""
    return F.when(possible, found).otherwise(F.array().cast("array<string>"))


def _has_digit(text: Column) -> Column:
    return text.rlike(r"(?U)\d")


def _has_amount(text: Column) -> Column:
    """Amounts may consist of commas alone."""
    return text.rlike(r"(?U)[\d,]")


def amounts(text: Column) -> Column:
    def hits(pattern: str) -> Column:
        found = _found(text, (pattern,), "(?iU)")
        sign = next((s for s in CURRENCY_SIGNS if pattern.lstrip("\\").startswith(s)), None)
        return _if(F.contains(text, F.lit(sign)), found) if sign else found

    return _if(_has_amount(text), F.concat(*[hits(p) for p in AMOUNT_PATTERNS]))


def dates(text: Column) -> Column:
    return _if(_has_digit(text), _found(text, DATE_PATTERNS, "(?iU)"))


def percentages(text: Column) -> Column:
    return _if(F.contains(text, F.lit("%")), _found(text, (PERCENT_PATTERN,), "(?U)"))


def companies(text: Column) -> Column:
    suffix = reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in COMPANY_SUFFIXES])
    return _if(suffix, _found(text, (COMPANY_PATTERN,), "(?U)", 1))


def entities(text: Column) -> Column:
    """The four entity lists as one struct."""
    return F.struct(
        amounts(text).alias("amounts"), dates(text).alias("dates"),
        percentages(text).alias("percentages"), companies(text).alias("companies"),
    )


def _occurrences(df: DataFrame, entity: str) -> DataFrame:
    """(kind, value) of each hit."""
    def tagged(kind: str) -> Column:
        return F.transform(
            F.col(f"{entity}.{kind}"), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
        )

    pairs = F.flatten(F.array(*[tagged(k) for k in ENTITY_KINDS]))
    return df.select(F.explode_outer(pairs).alias("e")).where(F.col("e").isNotNull()).select("e.kind", "e.value")


def entity_counts(df: DataFrame, entity: str = "entities") -> DataFrame:
    """Occurrences of each (kind, value) over all rows."""
    return _occurrences(df, entity).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def top_entities(df: DataFrame, limit: int, entity: str = "entities", tracked: int = 50_000) -> DataFrame:
    """The ``limit`` most frequent (kind, value, n), ties by kind and value, without an exchange of all values where that can be proved.

    A sketch that tracks ``tracked`` values names candidates, which are counted exactly. The sketch misses no value that occurs more than
    7 / ``tracked`` of all hits (twice its error bound). So the answer is proved if the last candidate taken occurs more often, or
    if the candidates are all there is; if neither holds, as with many rare values, all values are counted.
    """
    hits = cut(_occurrences(df, entity))
    key = F.concat_ws("\x1f", "kind", "value")
    seen = hits.agg(F.count(F.lit(1)).alias("hits"), F.call_function("approx_top_k", key, F.lit(tracked), F.lit(tracked)).alias("top"))
    # One row of at most ``tracked`` values, written once.
    seen = cut(seen)
    candidates = seen.select(F.explode("top.item").alias("key"))
    counted = hits.join(candidates, key == F.col("key"), "left_semi").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
    counted = cut(counted)
    order = [F.col("n").desc(), "kind", "value"]
    best = counted.orderBy(*order).limit(limit)
    total = seen.select("hits").first()[0]
    covered, last, found = (
        counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], *best.agg(F.min("n"), F.count(F.lit(1))).first())
    if covered == total or (found == limit and found and last > 7 * total / tracked):
        return best
    return hits.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")).orderBy(*order).limit(limit)


def paragraphs_to_text(paragraphs: Column) -> Column:
    """Stripped non-blank paragraphs of an array, joined by a blank line."""
    return F.array_join(F.filter(F.transform(paragraphs, strip), lambda p: p != ""), "\n\n")


def pages_to_rows(df: DataFrame, pages: str, keep: list[str]) -> DataFrame:
    """One row per non-blank page of an array of page texts; pages count from 1."""
    return (
        df.select(*keep, F.posexplode_outer(pages).alias("_pos", "_text"))
        .select(*keep, (F.col("_pos") + 1).alias("page_number"), strip(F.col("_text")).alias("page_text"))
        .where(F.col("page_text") != "")
    )
