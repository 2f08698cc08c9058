"""Files: routing, batches, text, CSV tables and CSV grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.clean import is_blank
from ..session import cut

# Kind of file by extension, and the size limit in bytes.
KIND_BY_EXTENSION = {
    ".xlsx": "excel", ".xls": "excel", ".csv": "csv", ".pdf": "pdf",
    ".txt": "text", ".doc": "word", ".docx": "word",
}
MAX_FILE_SIZE = 50 * 1024 * 1024

# The cell texts that count as missing in CSV files.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def extension(name: Column) -> Column:
    """Lower-case extension with its dot; names that only start with dots have none."""
    base = F.regexp_extract(name, r"[^/]*$", 0)
    return F.lower(F.regexp_extract(base, r"^\.*[^.].*?(\.[^.]*)$", 1))


def file_kind(name: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in KIND_BY_EXTENSION.items() for x in pair])
    return F.coalesce(F.try_element_at(kinds, extension(name)), F.lit("unknown"))


def list_directory(spark: SparkSession, path: str) -> DataFrame:
    """path, length and modificationTime of every file; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).drop("content")


def read_bytes(spark: SparkSession, path: str, max_size: int | None = None) -> DataFrame:
    """Whole files, or those up to ``max_size`` bytes; the size filter is pushed into the listing."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return df if max_size is None else df.where(F.col("length") <= max_size)


def scan_status(files: DataFrame) -> DataFrame:
    """Accept or refuse each file of a batch by (path, length)."""
    kind = file_kind(F.col("path"))
    return files.withColumn("file_type", kind).withColumn(
        "status",
        F.when(F.col("file_type") == "unknown", "FAILED").when(F.col("length") > MAX_FILE_SIZE, "FAILED")
        .otherwise("SUCCESS"),
    ).withColumn(
        "message",
        F.when(F.col("file_type") == "unknown", "Invalid file type")
        .when(F.col("length") > MAX_FILE_SIZE, "File too large").otherwise("Success"),
    )


def batch_totals(status: DataFrame) -> DataFrame:
    return status.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("status") != "FAILED").alias("successful"),
        F.count_if(F.col("status") == "FAILED").alias("failed"),
    )


def pick_encoding(content: Column) -> Column:
    return F.when(F.is_valid_utf8(content.cast("string")), "UTF-8").otherwise("ISO-8859-1")


def decode_text(content: Column) -> Column:
    """UTF-8 when valid, without its byte-order mark; else one byte per character."""
    utf8 = F.regexp_replace(content.cast("string"), "^﻿", "")
    return F.when(F.is_valid_utf8(content.cast("string")), utf8).otherwise(F.decode(content, "ISO-8859-1"))


def text_status(files: DataFrame) -> DataFrame:
    """Adds ``text`` and ``status`` (EMPTY or SUCCESS) to files with ``content``."""
    return files.withColumn("text", decode_text(F.col("content"))).withColumn(
        "status", F.when(is_blank(F.col("text")), "EMPTY").otherwise("SUCCESS")
    )


def read_text_files(spark: SparkSession, path: str, max_size: int | None = None) -> DataFrame:
    """One row for every listed file: path, length, text, status; a file over ``max_size`` bytes is FAILED without text."""
    read = text_status(read_bytes(spark, path, max_size)).select("path", "length", "text", "status")
    if max_size is None:
        return read
    large = list_directory(spark, path).where(F.col("length") > max_size)
    return read.unionByName(large.select("path", "length", F.lit(None).cast("string").alias("text"), F.lit("FAILED").alias("status")))


def content_hash(content: Column) -> Column:
    return F.md5(content)


# A quoted cell as far as its closing quote, and a cell as far as the next comma.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
_CLOSED_CELL = f",(?:{_QUOTED}[^,]*+|(?!\")[^,]*+)"


def _ends_inside(cells: Column) -> Column:
    """Whether cells, each behind a comma, end inside quotes: then something is left when all closed ones are taken away."""
    return F.regexp_replace(cells, _CLOSED_CELL, "") != ""


def _states(df: DataFrame, part: list[str], order: str, outside: str, inside: str) -> DataFrame:
    """Adds ``_from_out`` and ``_from_in``: is the place before a row inside quotes, if the part begins outside or inside of them.

    ``outside`` and ``inside`` tell if a row ends inside quotes when it begins outside or inside. A row where both are equal sets the state
    whatever came before; of the others only the number of changes since then matters.
    """
    here = Window.partitionBy(*part).orderBy(order)
    earlier = here.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.col(outside) & ~F.col(inside)
    known = F.when(F.col(outside) == F.col(inside), F.struct(F.col(outside).alias("state"), F.col("_turns").alias("turns")))
    df = df.withColumn("_turns", F.sum(turns.cast("long")).over(here)).withColumn("_known", F.last(known, ignorenulls=True).over(earlier))
    df = df.withColumn("_before", F.coalesce(F.lag("_turns").over(here), F.lit(0)))

    def odd(n: Column) -> Column:
        return n % 2 == 1

    last = F.col("_known.state") != odd(F.col("_before") - F.col("_known.turns"))
    return df.withColumns({
        "_from_out": F.coalesce(last, odd(F.col("_before"))), "_from_in": F.coalesce(last, ~odd(F.col("_before"))),
    }).drop("_turns", "_known", "_before")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files: file, row (from 0 per file, blank lines count), value.

    Cells in quotes may hold line breaks. Each split of a file tells, for both states of quotes it may begin in, how many records begin in it and
    in which state it ends; in order of the splits these compose to the true states, so a file is read by as many tasks as it has splits
    and only records of several lines are put together by a shuffle. Line breaks inside cells become line feeds. A file that ends inside
    quotes has a stray one: its lines are its records.
    """
    lines = spark.read.text(path, recursiveFileLookup=True).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_id"),
    )
    # What is left of a line behind the first quote that closes, and of that behind the cell it closes.
    closing = F.regexp_replace("value", r'^[^"]*+(?:""[^"]*+)*+', "")
    behind = F.regexp_replace(F.substring(closing, F.lit(2), F.length(closing)), "^[^,]*+", "")
    plain = ~F.contains("value", F.lit('"'))
    lines = lines.withColumns({
        "_out": ~plain & _ends_inside(F.concat(F.lit(","), "value")), "_in": plain | (closing == "") | _ends_inside(behind),
    })
    lines = _states(lines, ["file", "block"], "_id", "_out", "_in")

    def after(state: str) -> Column:
        return F.when(F.col(state), F.col("_in")).otherwise(F.col("_out"))

    splits = lines.groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("_lines"), F.count_if(~F.col("_from_out")).alias("_n_out"), F.count_if(~F.col("_from_in")).alias("_n_in"),
        F.max_by(after("_from_out"), "_id").alias("_end_out"), F.max_by(after("_from_in"), "_id").alias("_end_in"),
    )
    splits = _states(splits, ["file"], "block", "_end_out", "_end_in").drop("_from_in").withColumnRenamed("_from_out", "_begins")
    whole = Window.partitionBy("file")
    ends = F.when(F.col("_begins"), F.col("_end_in")).otherwise(F.col("_end_out"))
    splits = splits.withColumn("_stray", F.max_by(ends, "block").over(whole))
    records = F.when(F.col("_stray"), F.col("_lines")).when(F.col("_begins"), F.col("_n_in")).otherwise(F.col("_n_out"))
    earlier = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", "_begins", "_stray", F.coalesce(F.sum(records).over(earlier), F.lit(0)).alias("_rows"))

    met = lines.join(splits, ["file", "block"])
    met = met.withColumn("_inside", ~F.col("_stray") & F.when(F.col("_begins"), F.col("_from_in")).otherwise(F.col("_from_out")))
    opens = ~F.col("_stray") & after("_inside")
    begun = F.sum((~F.col("_inside")).cast("long")).over(Window.partitionBy("file", "block").orderBy("_id"))
    # Written, as whole lines and pieces of records are both taken from it.
    placed = cut(met.select(
        "file", "block", "_id", (F.col("_rows") + begun - 1).alias("row"), (F.col("_inside") | opens).alias("_piece"), "value",
    ))
    pieces = F.array_sort(F.collect_list(F.struct("block", "_id", "value")))
    joined = placed.where("_piece").groupBy("file", "row").agg(F.array_join(F.transform(pieces, lambda p: p["value"]), "\n").alias("value"))
    out = placed.where("not _piece").select("file", "row", "value").unionByName(joined)
    return out.withColumn("value", F.when(F.col("row") == 0, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value")))


def csv_fields(record: Column) -> Column:
    """The cells of a record, without quotes around them."""
    # A comma in front of the record lets each cell begin with one; records may be of any width.
    found = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(f",({_QUOTED}|[^,]*+)"), F.lit(1))

    def bare(cell: Column) -> Column:
        quoted = F.replace(F.substring(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))
        return F.when(F.startswith(cell, F.lit('"')) & F.endswith(cell, F.lit('"')) & (F.length(cell) > 1), quoted).otherwise(cell)

    return F.transform(found, bare)


def _header(records: DataFrame) -> list[str]:
    """Column names from the first record of each file; doubled ones get their position, empty ones are ``_c`` and it."""
    firsts = records.groupBy("file").agg(F.min_by("value", "row").alias("value")).select(csv_fields(F.col("value")).alias("cells"))
    found = firsts.distinct().take(2)
    if len(found) > 1:
        raise ValueError(f"files have different headers: {[r.cells for r in found]}")
    cells = found[0].cells if found else []
    lower = [c.lower() for c in cells]
    return [f"_c{i}" if not c else f"{c}{i}" if lower.count(c.lower()) > 1 else c for i, c in enumerate(cells)]


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = True
) -> DataFrame:
    """A CSV table with a header; missing-value texts become null, then types are inferred.

    Pass ``schema`` to skip the inferring pass. Quoted cells may hold line breaks; ``multi_line=False`` saves the pass that looks for them. Blank
    records are skipped, short ones end in nulls. Files whose headers differ are an error, as their columns would mix.
    """
    def na(c: Column) -> Column:
        return F.when(~c.isin(*NA_TOKENS), c)

    if multi_line:
        records = csv_records(spark, path).where(F.trim("value") != "")
        names = _header(records)
        first = records.groupBy("file").agg(F.min("row").alias("_first"))
        cells = records.join(first, "file").where("row > _first").select(csv_fields(F.col("value")).alias("_cells"))
        text = cells.select(*[na(F.get("_cells", F.lit(i))).alias(c) for i, c in enumerate(names)])
    else:
        raw = spark.read.options(header=True, quote='"', escape='"', enforceSchema=False).csv(path)
        names = raw.columns
        text = raw.select(*[na(F.col(f"`{c}`")).alias(c) for c in names])
    if schema is None:
        from ..operators.profile import SPARK_TYPES, infer_types

        types = {c: SPARK_TYPES[t] if t in ("INTEGER", "DOUBLE PRECISION", "BOOLEAN") else "string"
                 for c, t in infer_types(text).items()}
    else:
        given = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        types = {f.name: f.dataType for f in given}
    return text.select(*[F.col(f"`{c}`").try_cast(types[c]).alias(c) for c in names])


def csv_to_cells(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank cells of headerless CSV grids: file_id, sheet, row, col, value.

    Row numbers count all records of a file, blank lines too; cells in quotes may hold line breaks.
    """
    cells = csv_records(spark, path).where(F.length("value") > 0).select(
        F.sha2("file", 256).alias("file_id"), F.element_at(F.split("file", "/"), -1).alias("sheet"),
        "row", F.posexplode(csv_fields(F.col("value"))).alias("col", "value"),
    )
    return cells.where(~is_blank(F.col("value")))
