"""Tables inside sheet grids: detection, header promotion, typed tables.

A sheet is a sparse table of its non-blank cells ``(<sheet keys>, row, col, value)``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import is_blank
from ..session import cut
from .components import components
from .ordered import numbered

TILE = 256
#: Square sides of the grids rectangles are laid out on, in bits.
SQUARE_BITS = (4, 8, 12, 16, 20)
#: Rows of a stripe, in bits. Stripes part the cells of a large square, so that one large table is many join keys.
STRIPE_BITS = 16

# Executors get the kernels below with the task and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def nonblank(cells: DataFrame, value: str = "value") -> DataFrame:
    return cells.where(~is_blank(F.col(value)))


def _components_of(key: np.ndarray, width: int) -> np.ndarray:
    """For each cell the index of the first cell of its component.

    ``key`` is sorted and numbers the cells row by row in rows of ``width``, wide
    enough that the last cell of a row never neighbours the first of the next.
    """
    n = len(key)
    same = np.flatnonzero(key[1:] == key[:-1])
    left, right = [same], [same + 1]
    for step in (1, width - 1, width, width + 1):
        at = np.searchsorted(key, key + step)
        hit = np.flatnonzero(key[np.minimum(at, n - 1)] == key + step)
        left.append(hit)
        right.append(at[hit])
    a, b = np.concatenate(left), np.concatenate(right)
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        open_pairs = la != lb
        a, b, la, lb = a[open_pairs], b[open_pairs], la[open_pairs], lb[open_pairs]
        low = np.minimum(la, lb)
        np.minimum.at(label, np.maximum(la, lb), low)
        up = label[label]
        while not np.array_equal(up, label):
            label, up = up, up[up]
    return label


def _group_starts(pdf: pd.DataFrame, on: list[str]) -> np.ndarray:
    """Positions at which a new (sheet, tile) begins in sorted rows."""
    new = np.zeros(len(pdf), dtype=bool)
    new[0] = True
    for k in on:
        v = pdf[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _tile_boxes(pdf: pd.DataFrame, keys: list[str], on: list[str], tile: int, borders: bool, min_area: int) -> pd.DataFrame:
    """Components of all whole tiles in ``pdf``: one row each, and if asked one row per border cell.

    Without these a tile is a whole sheet: components below ``min_area`` are left out and ``table_no`` counts the others of a sheet
    by their first cells.
    """
    starts = _group_starts(pdf, on)
    group = np.zeros(len(pdf), dtype=np.int64)
    group[starts] = 1
    group = np.cumsum(group) - 1
    row, col = pdf["row"].to_numpy(), pdf["col"].to_numpy()
    lr, lc = row - pdf["_tr"].to_numpy() * tile, col - pdf["_tc"].to_numpy() * tile
    # An empty row parts two tiles, an empty column on either side parts two rows.
    label = _components_of((group * (tile + 1) + lr) * (tile + 2) + lc + 1, tile + 2)
    order = np.argsort(label, kind="stable")
    first, at, n = np.unique(label[order], return_index=True, return_counts=True)
    boxes = pdf[keys].iloc[first].assign(
        pr=row[first], pc=col[first],
        r0=np.minimum.reduceat(row[order], at), r1=np.maximum.reduceat(row[order], at),
        c0=np.minimum.reduceat(col[order], at), c1=np.maximum.reduceat(col[order], at), n_cells=n,
    )
    if not borders:
        large = ((boxes["r1"] - boxes["r0"] + 1) * (boxes["c1"] - boxes["c0"] + 1) >= min_area).to_numpy()
        sheet = pd.Series(group[first][large])
        return boxes[large].assign(table_no=sheet.groupby(sheet).cumcount().to_numpy() + 1)
    edge = np.flatnonzero((lr == 0) | (lr == tile - 1) | (lc == 0) | (lc == tile - 1))
    cells = pdf[keys].iloc[edge].assign(
        pr=row[label[edge]], pc=col[label[edge]], r0=row[edge], r1=row[edge], c0=col[edge], c1=col[edge], n_cells=0,
    )
    return pd.concat([boxes, cells])


def _tile_groups(cells: DataFrame, keys: list[str], tile: int, borders: bool, min_area: int = 1) -> DataFrame:
    """Components within each tile: ``keys, pr, pc`` (first cell), the rectangle and ``n_cells``.

    Border cells follow as rows with ``n_cells = 0``; without them, that is for sheets of one tile, components have a ``table_no``. The one Python step: rows come
    sorted by sheet and tile, many tiles are labelled at once, and only the last,
    unfinished tile (at most ``tile * tile`` cells) waits for the next batch.
    """
    on = [*keys, "_tr", "_tc"]
    fields = [f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys]
    numbers = [f"{c} bigint" for c in ("pr", "pc", "r0", "r1", "c0", "c1", "n_cells", *([] if borders else ["table_no"]))]

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            if pdf.empty:
                continue
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            last = _group_starts(pdf, on)[-1]
            rest = pdf.iloc[last:].reset_index(drop=True)
            if last:
                yield _tile_boxes(pdf.iloc[:last], keys, on, tile, borders, min_area)
        if rest is not None:
            yield _tile_boxes(rest, keys, on, tile, borders, min_area)

    placed = cells.select(
        *keys, F.col("row").cast("bigint"), F.col("col").cast("bigint"),
        F.floor(F.col("row") / tile).alias("_tr"), F.floor(F.col("col") / tile).alias("_tc"),
    )
    sorted_cells = placed.repartition(*on).sortWithinPartitions(*on, "row", "col")
    return sorted_cells.mapInPandas(label, ", ".join([*fields, *numbers]))


def _tile_edges(border: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of tile components that touch across a tile border, by equi-joins of border cells."""
    steps = F.array(*[
        F.struct(F.lit(dr).cast("bigint").alias("dr"), F.lit(dc).cast("bigint").alias("dc"))
        for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1))
    ])
    node = F.struct(*keys, "pr", "pc")
    at = border.select(*keys, F.col("r0").alias("row"), F.col("c0").alias("col"), node.alias("v"))
    reach = at.select(*keys, "row", "col", F.col("v").alias("u"), F.explode(steps).alias("s")).select(
        *keys, "u", (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col")
    )
    return reach.join(at, [*keys, "row", "col"]).where("u <> v").select("u", "v").distinct()


def detect_tables(
    cells: DataFrame, keys: list[str], min_area: int = 2, tile: int = TILE, number: bool = True
) -> DataFrame:
    """Bounding rectangles of the 8-connected groups of cells of each sheet.

    Returns ``keys, r0, r1, c0, c1, n_cells`` and, in order of each group's first
    cell, ``table_no`` from 1. ``min_area=2`` drops single cells, ``1`` keeps all.

    Cells are grouped per tile first; only groups that meet at a tile border take
    part in the iterative contraction. When all sheets fit in one tile there is none.
    """
    lr, lc = F.floor(F.col("row") / tile), F.floor(F.col("col") / tile)
    extent = cells.agg(F.min(lr), F.max(lr), F.min(lc), F.max(lc)).first()
    one_tile = extent[0] == extent[1] and extent[2] == extent[3]
    if one_tile:
        found = _tile_groups(cells, keys, tile, False, min_area).drop("pr", "pc")
        return cut(found) if number else found.drop("table_no")
    groups = cut(_tile_groups(cells, keys, tile, True))
    label = components(_tile_edges(groups.where("n_cells = 0"), keys))
    groups = (
        groups.where("n_cells > 0").withColumn("node", F.struct(*keys, "pr", "pc")).join(label, "node", "left")
        .withColumn("root", F.coalesce("label", "node"))
        .groupBy("root").agg(
            F.min("r0").alias("r0"), F.max("r1").alias("r1"),
            F.min("c0").alias("c0"), F.max("c1").alias("c1"), F.sum("n_cells").alias("n_cells"),
        )
        .select("root.*", "r0", "r1", "c0", "c1", "n_cells")
    )
    kept = groups.where((F.col("r1") - F.col("r0") + 1) * (F.col("c1") - F.col("c0") + 1) >= min_area)
    if not number:
        return kept.drop("pr", "pc")
    return numbered(kept, keys, [F.col("pr"), F.col("pc")], "table_no").drop("pr", "pc")


def _level(size) -> Column:
    """Bits of the smallest square side that is not below ``size``."""
    out = F.lit(SQUARE_BITS[-1])
    for bits in reversed(SQUARE_BITS[:-1]):
        out = F.when(size <= 1 << bits, F.lit(bits)).otherwise(out)
    return out


def squares(tables: DataFrame, keys: list[str]) -> DataFrame:
    """The grid squares each rectangle reaches: at most four, as its squares are no smaller than itself.

    Only a side beyond the largest square, of 2^20, reaches more: two and one for each 2^20 of its length. And rectangles that fit
    the second square lie on the grid of the first, so that cells look into one grid for all of them. Such a rectangle of h x w reaches
    (h / 16 + 2) * (w / 16 + 2) squares at most, 289 for the largest, which holds 256 cells or more, as they touch.
    """
    leveled = tables.select(
        *keys, "table_no", "r0", "r1", "c0", "c1", _level(F.col("r1") - F.col("r0") + 1).alias("_lr"),
        _level(F.col("c1") - F.col("c0") + 1).alias("_lc"),
    )
    small = F.greatest("_lr", "_lc") <= SQUARE_BITS[1]
    leveled = leveled.withColumns({x: F.when(small, F.lit(SQUARE_BITS[0])).otherwise(F.col(x)) for x in ("_lr", "_lc")})
    down = leveled.withColumn("_tr", F.explode(F.expr("sequence(shiftright(r0, _lr), shiftright(r1, _lr))")))
    return down.withColumn("_tc", F.explode(F.expr("sequence(shiftright(c0, _lc), shiftright(c1, _lc))")))


def table_cells(cells: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    """All cells inside each table's rectangle (a cell may lie in several).

    Rectangles are laid out on grids of a few fixed square sizes, each on the one that suits it, and a cell looks
    into its square of every grid in use. The sizes in use, at most 25 pairs, come to the driver. Large squares are
    cut into stripes of rows, so the cells of a table of any length meet it under many keys.
    """
    stripes = f"sequence(shiftright(greatest(r0, shiftleft(_tr, _lr)), {STRIPE_BITS}), shiftright(least(r1, shiftleft(_tr + 1, _lr) - 1), {STRIPE_BITS}))"
    spread = squares(tables, keys).withColumn("_stripe", F.explode(F.expr(stripes)))
    used = spread.select("_lr", "_lc").distinct().collect()
    if not used:
        used = [(SQUARE_BITS[0], SQUARE_BITS[0])]
    grids = F.explode(F.array(*[F.struct(F.lit(r).alias("_lr"), F.lit(c).alias("_lc")) for r, c in used]))
    placed = cells.withColumn("_g", grids).select("*", "_g._lr", "_g._lc").drop("_g").withColumns(
        {"_tr": F.expr("shiftright(row, _lr)"), "_tc": F.expr("shiftright(col, _lc)"), "_stripe": F.expr(f"shiftright(row, {STRIPE_BITS})")}
    )
    return (
        placed.join(spread, [*keys, "_lr", "_lc", "_tr", "_tc", "_stripe"])
        .where("row between r0 and r1 and col between c0 and c1")
        .drop("_lr", "_lc", "_tr", "_tc", "_stripe")
    )


def promote_header(in_tables: DataFrame, keys: list[str], value: str = "value", rows: int = 65_536) -> DataFrame:
    """Data cells with the text of their column's header: the first row of a rectangle names its columns.

    Input is the result of ``table_cells``; ``data_row`` counts from 0 below the header.
    A column without header text gets a null ``header``. A header is repeated for each
    stretch of ``rows`` rows, so a column of any length is joined in bounded pieces.
    """
    on = [*keys, "table_no", "col", "_part"]
    # Both sides come from it, and finding the cells of tables is the dear part.
    in_tables = cut(in_tables)

    def part(row: str):
        return F.floor((F.col(row) - F.col("r0")) / rows)

    header = in_tables.where("row = r0").select(
        *keys, "table_no", "col", F.col(value).alias("header"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), part("r1"))).alias("_part"),
    )
    data = in_tables.where("row > r0").withColumn("_part", part("row"))
    return data.join(header, on, "left").select(
        *keys, "table_no", (F.col("row") - F.col("r0") - 1).alias("data_row"), "col", "header", value
    )


def header_cells(in_tables: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The header cells: ``position`` from 0 and the header text."""
    return in_tables.where("row = r0").select(
        *keys, "table_no", (F.col("col") - F.col("c0")).alias("position"), F.col(value).alias("header")
    )


def cells_to_table(
    cells: DataFrame, row_keys: list[str], columns: dict[int, tuple[str, str]], position: str = "col",
    value: str = "value",
) -> DataFrame:
    """Long cells to a typed wide table; ``columns`` maps a position to (name, Spark type)."""
    wide = cells.groupBy(*row_keys).agg(*[
        F.max(F.when(F.col(position) == pos, F.col(value))).try_cast(dtype).alias(name)
        for pos, (name, dtype) in columns.items()
    ])
    return wide


def table_names(tables: DataFrame, keys: list[str], sheet_name: str) -> DataFrame:
    """``clean_name``: the sheet name, with ``_Table{i}`` when the sheet holds more than one table.

    Only the first table of a sheet has to ask whether there is a second one, so the
    join sees one row per sheet and side.
    """
    second = tables.where("table_no = 2").select(*keys, F.lit(True).alias("_more"))
    first = tables.where("table_no = 1").join(second, keys, "left")
    rest = tables.where("table_no > 1").withColumn("_more", F.lit(True))
    numbered_name = F.concat(F.col(sheet_name), F.lit("_Table"), F.col("table_no").cast("string"))
    return first.unionByName(rest).withColumn(
        "clean_name", F.when(F.col("_more"), numbered_name).otherwise(F.col(sheet_name))
    ).drop("_more")
