"""From sheet grids to described tables: detection, names, types, roles, samples and catalogue rows."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import dedup_names, normalize_name, sheet_table_name
from ..session import cut
from .cells import cells_to_table, detect_tables, nonblank, table_cells, table_names
from .ordered import numbered
from .profile import SPARK_TYPES, TYPE_LADDER, column_role, fast_keywords, fast_summary, FAST_CATEGORY, pick_type, reads_as


#: Rows that a task holds before it passes them on.
HELD_ROWS = 200_000

# Executors get the kernel below with the task and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _firsts(rows: pd.DataFrame, by: list[str], row: str, value: str, n: int) -> pd.DataFrame:
    """The rows of the first ``n`` distinct values per ``by``."""
    rows = rows.sort_values(row, kind="stable").drop_duplicates([*by, value])
    return rows[rows.groupby(by, dropna=False, sort=False).cumcount() < n]


def first_samples(data: DataFrame, by: list[str], row: str, value: str, n: int = 3) -> DataFrame:
    """The first ``n`` distinct values per ``by`` in row order.

    A value that is among the first of all is among the first of its task, so a task passes on ``n`` rows per column and
    values are never exchanged.
    """
    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = _firsts(batch if held is None else pd.concat([held, batch]), by, row, value, n)
            if len(held) > HELD_ROWS:
                yield held
                held = None
        if held is not None:
            yield held

    rows = data.select(*by, row, value)
    few = rows.mapInPandas(reduced, rows.schema)
    found = F.array_sort(F.collect_list(F.struct(F.col(row).alias("row"), F.col(value).alias("value"))))

    def more(firsts: Column, x: Column) -> Column:
        new = (F.size(firsts) < n) & ~F.array_contains(firsts, x["value"])
        return F.when(new, F.array_append(firsts, x["value"])).otherwise(firsts)

    none = F.array().cast(T.ArrayType(rows.schema[value].dataType))
    return few.groupBy(*by).agg(found.alias("_found")).select(*by, F.aggregate("_found", none, more).alias("samples"))


def describe_columns(inside: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """One row per column that holds data: ``col, original_name, name, type, role, samples``.

    ``inside`` is what ``table_cells`` gives. Header and type come from one aggregation over the cells, without a join of
    cells to headers. Columns with a header but no data are dropped.
    """
    by = [*keys, "table_no", "col"]
    data = F.when(F.col("row") > F.col("r0"), F.col(value))
    hits = {f"_h{i}": F.count_if(ok) for i, ok in enumerate(reads_as(data))}
    found = inside.groupBy(*by).agg(
        F.max(F.when(F.col("row") == F.col("r0"), F.col(value))).alias("original_name"),
        F.count(data).alias("_filled"), *[h.alias(n) for n, h in hits.items()],
    ).where("_filled > 0")
    samples = first_samples(inside.where("row > r0"), by, "row", value)
    # Both sides lie by the same key, so the join needs no exchange of its own.
    typed = found.join(samples, by).select(
        *by, "original_name", normalize_name(F.col("original_name")).alias("_norm"),
        pick_type(F.col("_filled"), [F.col(f"_h{i}") for i in range(len(TYPE_LADDER))]).alias("type"), "samples",
    )
    named = dedup_names(cut(typed), [*keys, "table_no"], "col", "_norm", "name")
    return named.select(*by, "original_name", "type", "name", column_role(F.col("name"), F.col("type")).alias("role"), "samples")


def describe_sheets(
    tables: DataFrame, columns: DataFrame, keys: list[str], sheet_name: str, file_id: Column
) -> DataFrame:
    """Catalogue rows: one per table with data, its columns in one array (as wide as the sheet, no wider)."""
    meta = F.struct("name", "original_name", "type", "role", "samples")
    wide = columns.groupBy(*keys, "table_no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("col", meta.alias("m")))), lambda s: s["m"]).alias("columns_metadata")
    )
    named = table_names(tables, keys, sheet_name)
    names = F.col("columns_metadata.name")
    rows = F.col("r1") - F.col("r0")
    titled = named.withColumn("_table_name", sheet_table_name(F.col("clean_name"), file_id))
    # Sheets of a file whose names normalise equally: the second and later ones get an ordinal.
    nth = numbered(titled, ["_table_name"], [*[F.col(k) for k in keys], F.col("table_no")], "_nth")
    ordinal = F.when(F.col("_nth") > 1, F.concat(F.lit("_"), F.col("_nth").cast("string"))).otherwise(F.lit(""))
    # Cells touch from row to row, so no row of a table is empty and the rectangle gives the count.
    return nth.join(wide, [*keys, "table_no"]).select(
        *keys, "table_no", F.col("clean_name").alias("sheet_title"),
        F.concat("_table_name", ordinal).alias("table_name"),
        rows.alias("num_rows"), F.size("columns_metadata").alias("num_columns"),
        F.lit(FAST_CATEGORY).alias("category"), fast_summary(rows, F.size("columns_metadata")).alias("summary"),
        fast_keywords(names).alias("keywords"), "columns_metadata",
    )


def ingest_cells(
    cells: DataFrame, keys: list[str], sheet_name: str, file_id: Column, value: str = "value"
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(tables, cells inside them, columns, catalogue rows) of all sheets of a batch of files.

    Cells are read three times, so those that are dear to make should be written before. The cells inside tables are written once,
    for the columns, their samples and all that comes after.
    """
    filled = nonblank(cells, value)
    tables = cut(detect_tables(filled, keys))
    inside = cut(table_cells(filled.select(*keys, "row", "col", value), tables, keys))
    columns = cut(describe_columns(inside, keys, value))
    return tables, inside, columns, describe_sheets(tables, columns, keys, sheet_name, file_id)


def ingest(
    cells: DataFrame, keys: list[str], sheet_name: str, file_id: Column, value: str = "value"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tables, columns, catalogue rows) of all sheets of a batch of files."""
    tables, _, columns, sheets = ingest_cells(cells, keys, sheet_name, file_id, value)
    return tables, columns, sheets


def load_table(
    cells: DataFrame, tables: DataFrame, columns: DataFrame, keys: list[str], where: Column, value: str = "value"
) -> DataFrame:
    """One detected table as a typed DataFrame; ``where`` picks it by keys and ``table_no``."""
    schema = {r["col"]: (r["name"], SPARK_TYPES[r["type"]]) for r in columns.where(where).orderBy("col").collect()}
    names = [name for name, _ in schema.values()]
    if len(set(names)) < len(names):
        raise ValueError(f"column names still occur twice: {sorted({n for n in names if names.count(n) > 1})}")
    inside = table_cells(cells, tables.where(where), keys).where("row > r0")
    return cells_to_table(inside, [*keys, "table_no", "row"], schema, "col", value).drop(*keys, "table_no").orderBy("row").drop("row")
