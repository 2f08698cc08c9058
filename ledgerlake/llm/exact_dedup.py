"""Exact dedup with DataFrame functions only: 128-bit content hash, then a comparison of bytes.

Texts go through one shuffle, and only to compare the members of groups of equal hash; all else works on hashes.
Keys of groups are salted wherever rows meet them, so a group that owns most rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

SALTS = 32


def content_hash(text: Column) -> Column:
    """128 bits of the UTF-8 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def _salted(df: DataFrame) -> DataFrame:
    """``df``, once for each salt. As it grows with the data, it is never sent whole to all tasks."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")


def _salt() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")


def _collided(texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """The hashes in whose groups the bytes differ. Copies shrink to one row per task before a shuffle by text."""
    met = texts.join(_salted(repeated), ["key", "salt"], "left_semi").select("key", "text").distinct()
    return met.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
    normalise: Callable[[Column], Column] = lambda text: text, digest: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.

    Rows are equal when their normalised texts have the same bytes; null counts as empty, before and after. Of equal
    rows the one with the smallest (``keep="max"``: largest) id stays. Rows that repeat an id and its text are all
    marked as kept, as they are the same document. A row without an id stays only if no equal row has one; its
    ``keep_id`` is then null. Other columns of ``docs`` are not read. An empty table gives an empty result.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is min or max")
    best = F.min if keep == "min" else F.max
    text = F.coalesce(normalise(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    texts = texts.select("doc_id", "text", digest(F.col("text")).alias("key"), _salt())
    marked = cut(texts.select("doc_id", "key", "salt", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")))
    groups = cut(
        marked.groupBy("key").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    )
    collided = cut(_collided(texts, groups.select("key")))
    out = ["doc_id", "keep_id", "group_size", "text_sha256"]
    named = marked.join(_salted(groups), ["key", "salt"], "left").select(
        "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "text_sha256", "key",
    )
    if collided.isEmpty():
        named = named.select(*out)
    else:
        # Hashes that several texts share: their rows are grouped by the text itself.
        apart = texts.join(_salted(collided), ["key", "salt"], "left_semi")
        own = apart.groupBy("key", "text").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        again = apart.join(_salted(own), ["key", "salt", "text"]).select(
            "doc_id", "keep_id", "group_size", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
        )
        named = named.join(collided, "key", "left_anti").select(*out).unionByName(again.select(*out))
    return named.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
