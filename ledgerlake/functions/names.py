"""Identifier names from free header and sheet text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import numbered

# Words that may not stand alone as an identifier.
RESERVED = (
    "order", "user", "group", "table", "limit", "offset", "select", "where", "from",
    "create", "insert", "update", "delete", "drop", "alter", "primary", "key", "references",
)


def _snake(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def normalize_name(text: Column) -> Column:
    """Default rule: snake case, ``unnamed`` for nothing, ``_`` before digits and reserved words."""
    s = _snake(F.coalesce(text, F.lit("")))
    return (
        F.when(s == "", "unnamed")
        .when(s.rlike("^[0-9]") | s.isin(*RESERVED), F.concat(F.lit("_"), s))
        .otherwise(s)
    )


def normalize_name_csv(text: Column) -> Column:
    """CSV rule: letters and digits of any script stay, each other character becomes ``_``."""
    s = F.regexp_replace(F.coalesce(text, F.lit("None")), r"[^\p{L}\p{N}]", "_")
    return F.btrim(F.lower(s), F.lit("_"))


def normalize_name_word(text: Column) -> Column:
    """Document-table rule: snake case, ``col_`` before digits or nothing."""
    s = _snake(F.coalesce(text, F.lit("None")))
    return F.when((s == "") | s.rlike("^[0-9]"), F.concat(F.lit("col_"), s)).otherwise(s)


def short_id(file_id: Column) -> Column:
    """First eight characters of an id without dashes."""
    return F.substring(F.replace(file_id, F.lit("-"), F.lit("")), 1, 8)


def sheet_table_name(sheet_name: Column, file_id: Column) -> Column:
    return F.concat_ws("_", F.lit("sheet"), normalize_name(sheet_name), short_id(file_id))


def csv_table_name(sheet_name: Column, file_id: Column) -> Column:
    return F.concat_ws("_", F.lit("data"), short_id(file_id), normalize_name_csv(sheet_name))


def word_table_name(index: Column, file_id: Column) -> Column:
    return F.concat_ws("_", F.lit("word_table"), short_id(file_id), index.cast("string"))


def dedup_names(df: DataFrame, table: list[str], position: str, name: str, out: str = "final_name") -> DataFrame:
    """The n-th repeat of a name within a table gets the n-th suffix ``_k``, k from 1, whose result is not a name of the table itself.

    Two names with suffixes never meet, as the last suffix tells the name before it; so all results of a table differ.
    """
    base, number = (F.regexp_extract(name, r"^(.*)_([1-9][0-9]{0,8})$", g) for g in (1, 2))
    # One value for the table, in which nulls are equal, so that numbering and join deal rows out by the same key.
    rest = [c for c in df.columns if c not in table]
    rows = df.select(F.struct(*table, F.lit(None).cast("int").alias("_any")).alias("_in"), *rest)
    taken = rows.select("_in", base.alias("_base"), number.alias("_number")).where("_number <> ''")
    taken = taken.groupBy("_in", F.col("_base").alias(name)).agg(F.array_sort(F.collect_set(F.col("_number").cast("int"))).alias("_taken"))
    d = numbered(rows, ["_in", name], [F.col(position)], "_nth").join(taken, ["_in", name], "left")
    repeat = (F.col("_nth") - 1).cast("int")
    free = F.when(F.col("_taken").isNull(), repeat).otherwise(
        F.aggregate("_taken", repeat, lambda k, used: F.when(used <= k, k + 1).otherwise(k))
    )
    final = F.when(F.col("_nth") == 1, F.col(name)).otherwise(F.concat_ws("_", F.col(name), free.cast("string")))
    return d.withColumn(out, final).select(*[F.col(f"_in.{c}") if c in table else F.col(c) for c in df.columns], out)


def name_collisions(df: DataFrame, table: list[str], name: str = "final_name") -> DataFrame:
    """Names used twice in one table; empty for the results of ``dedup_names``."""
    return df.groupBy(*table, name).count().where("count > 1")
