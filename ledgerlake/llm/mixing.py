"""Mixing sources to target weights by systematic sampling.

A source's target, divided by its size, is the number of copies expected of each of its documents.
Along the documents of a source, ordered by size, the expected copies add up; one random offset is added, and a
document is taken once for each whole number that the sum passes at it. As neighbours are of similar size, the words taken stay
within about one document of the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import Ordered, numbered
from ..session import cut
from .words import WORD, row_key, whole_row

WEIGHTS = (3, 1, 2)
#: Copies of a row that one task makes; those of rows that repeat very often are dealt over many.
CHUNK = 1_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) for each source of ``sized`` (source, size).

    Sources in order of code points, null last, weigh ``weights`` in turn and share ``share`` times all sizes. A target
    stops at ``cap`` times its source's size; what is over goes to the others by weight until none is above.
    """
    sums = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = numbered(sums, [], [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = cut(ranked.withColumn("weight", weight.cast("double")).withColumn("most", F.col("source_size") * F.lit(float(cap))))
    whole = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    to_share, to_weigh = float(whole[0] or 0) * share, float(whole[1] or 0)
    spent, weighed = 0.0, 0.0
    while True:
        # Two sums come back per round. A source that is full stays so, as what the others get only grows.
        left, over = to_share - spent, to_weigh - weighed
        full = F.col("most") * over <= F.col("weight") * left if over > 0 else F.lit(True)
        now = ranked.where(full).agg(F.coalesce(F.sum("most"), F.lit(0.0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
        if (now[0], now[1]) == (spent, weighed):
            break
        spent, weighed = now
    part = F.col("weight") * F.lit(left) / F.lit(over) if over > 0 else F.col("most")
    return ranked.select("source", "source_size", F.when(full, F.col("most")).otherwise(part).alias("target"))


def offset(source: Column, seed: int) -> Column:
    """A number from 0 to 1 for a source, the same in each run."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("")).cast("string")).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 32))


def _counted(sized: DataFrame, ties: list[str], weights: tuple[int, ...], share: float, cap: float, seed: int) -> DataFrame:
    """``sized`` (doc_id, source, size, ties) with source_size, target and copies."""
    placed = Ordered(sized, ["source"], [F.col("size"), F.col("doc_id"), *map(F.col, ties)], blocked=True).number("i").done()
    goal = targets(placed.select("source", "size"), weights, share, cap).withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = offset(F.col("source"), seed)
    joined = placed.join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    taken = F.floor(F.col("i") * rate + start) - F.floor((F.col("i") - 1) * rate + start)
    return joined.withColumn("copies", taken.cast("long"))


def copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 0,
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: one row per row of ``docs``.

    ``size`` is the number of words, 0 for a null or empty text. Null is a source of its own. Documents of a source are ordered by size,
    then id, then a hash of the text; rows without an id come first of their size. A source without words has target 0.
    An empty table gives an empty result.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"),
        F.xxhash64(text_col).alias("tie"),
    )
    counted = _counted(sized, ["tie"], weights, share, cap, seed)
    return counted.select("doc_id", "source", "size", "source_size", "target", "copies")


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 0,
) -> DataFrame:
    """The rows of ``docs``, each as often as it is taken; columns stay as they are, whatever their names.

    Rows meet their copies by a hash of all columns. Rows that are equal in all of them are interchangeable, so they are taken once and made as
    often as all of them together are taken.
    """
    keyed = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"),
        *row_key(docs), whole_row(docs).alias("row"),
    )
    key = ["key_1", "key_2"]
    counted = _counted(keyed.drop("row"), key, weights, share, cap, seed)
    sums = cut(counted.groupBy(*key).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")))
    rows, repeated = keyed.select(*key, "row"), not sums.where("rows > 1").isEmpty()
    if repeated:
        rows = rows.groupBy(*key).agg(F.any_value("row").alias("row"))
    met = rows.join(sums.where("copies > 0"), key)
    nth = F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(CHUNK)))).alias("nth")
    out = met.where(F.col("copies") <= CHUNK).select("row", nth)
    if repeated:
        parts = met.where(F.col("copies") > CHUNK).select(
            *key, "row", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {CHUNK}"))).alias("part"))
        left = parts.repartition(*key, "part").withColumn("copies", F.col("copies") - F.col("part") * CHUNK)
        out = out.unionByName(left.select("row", nth))
    return out.select("row.*")
