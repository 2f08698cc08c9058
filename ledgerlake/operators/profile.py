"""Types, roles, samples and descriptions of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# Name parts that decide the default role.
DATE_PARTS = ("date", "time", "period", "year", "month", "day", "timestamp")
REVENUE_PARTS = (
    "revenue", "income", "sales", "billing", "turnover", "inflow", "amount", "credit", "receivable",
)
EXPENSE_PARTS = ("expense", "cost", "spending", "outflow", "debit", "payable", "fee", "charge")
MONTH_PARTS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
NUMERIC_ID_PARTS = ("id", "code", "num_")
ID_PARTS = ("id", "code", "ref", "name", "vendor", "customer", "client", "project", "sku")
# Name parts that decide the role in CSV files.
CSV_TIME_PARTS = ("date", "year", "month", "time")
CSV_KEY_PARTS = ("id", "code")
CSV_METRIC_PARTS = ("total", "sum", "revenue", "profit", "cost")

# Narrowest type first; the first that reads every value is taken.
TYPE_LADDER = (
    ("BOOLEAN", "boolean", r"(?i)^\s*(true|false)\s*$"),
    ("INTEGER", "bigint", r"^\s*[-+]?[0-9]+\s*$"),
    ("DOUBLE PRECISION", "double", r"^\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"),
    ("TIMESTAMP", "timestamp_ntz", r"^\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}.*$"),
)
SPARK_TYPES = {name: spark for name, spark, _ in TYPE_LADDER} | {"TEXT": "string"}


def declared_type(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "BOOLEAN"
    if isinstance(dtype, T.IntegralType):
        return "INTEGER"
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return "DOUBLE PRECISION"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "TIMESTAMP"
    return "TEXT"


def reads_as(text: Column) -> list[Column]:
    """For each type of the ladder, whether the text reads as it."""
    return [text.rlike(form) & text.try_cast(spark).isNotNull() for _, spark, form in TYPE_LADDER]


def pick_type(filled: Column, hits: list[Column]) -> Column:
    """The narrowest type whose hit count equals the count of filled values."""
    chain = F.when(filled == 0, "TEXT")
    for (name, _, _), hit in zip(TYPE_LADDER, hits):
        chain = chain.when(hit == filled, name)
    return chain.otherwise("TEXT")


def infer_types(df: DataFrame, columns: list[str] | None = None) -> dict[str, str]:
    """Types of text columns from one aggregation over the table."""
    columns = columns or df.columns
    aggs = []
    for i, c in enumerate(columns):
        text = F.col(c).cast("string")
        hits = [F.count_if(ok) for ok in reads_as(text)]
        aggs.append(pick_type(F.count(text), hits).alias(str(i)))
    row = df.agg(*aggs).first()
    return {c: row[i] for i, c in enumerate(columns)}


def infer_types_by(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Types of many columns in long form: one row per ``by`` with ``filled`` and ``type``."""
    text = F.col(value).cast("string")
    names = [f"_h{i}" for i in range(len(TYPE_LADDER))]
    counted = df.groupBy(*by).agg(
        F.count(text).alias("filled"), *[F.count_if(ok).alias(n) for n, ok in zip(names, reads_as(text))]
    )
    return counted.select(*by, "filled", pick_type(F.col("filled"), [F.col(n) for n in names]).alias("type"))


def _has(name: Column, parts, strict: bool) -> Column:
    joined = "|".join(p.rstrip("_") if strict else p for p in parts)
    return name.rlike(f"(^|_)({joined})(_|$)" if strict else joined)


def column_role(name: Column, dtype: Column, strict: bool = False) -> Column:
    """Role from name and type; ``strict`` matches whole words of a snake-case name only."""
    n = F.lower(name)
    numeric = dtype.isin("DOUBLE PRECISION", "INTEGER")
    return (
        F.when((dtype == "TIMESTAMP") | _has(n, DATE_PARTS, strict), "date")
        .when(numeric & _has(n, REVENUE_PARTS, strict), "revenue")
        .when(numeric & _has(n, EXPENSE_PARTS, strict), "expense")
        .when(numeric & _has(n, MONTH_PARTS, strict), "monthly_metric")
        .when(numeric & _has(n, NUMERIC_ID_PARTS, strict), "identifier")
        .when(_has(n, ID_PARTS, strict), "identifier")
        .otherwise("other")
    )


def column_role_csv(name: Column, dtype: Column) -> Column:
    """Role by the CSV rule."""
    n = F.lower(name)
    return (
        F.when(_has(n, CSV_TIME_PARTS, False), "dimension_time")
        .when(_has(n, CSV_KEY_PARTS, False), "dimension_key")
        .when(_has(n, CSV_METRIC_PARTS, False), "metric")
        .when(dtype.isin("DOUBLE PRECISION", "INTEGER"), "metric")
        .otherwise("dimension")
    )


def first_distinct(df: DataFrame, columns: list[str], order: list[str], n: int = 3) -> dict[str, list[str]]:
    """The first ``n`` distinct non-null values of every column, as text, in row order.

    One aggregation per value found: each pass takes, for all columns at once, the
    earliest value not seen yet. Nothing but the running minimum is kept, so there is
    no shuffle of values however many distinct ones a column has.
    """
    found: dict[str, list[str]] = {c: [] for c in columns}
    open_columns = list(columns)
    pos = F.struct(*order)
    for _ in range(n):
        if not open_columns:
            break
        aggs = []
        for i, c in enumerate(open_columns):
            text = F.col(c).cast("string")
            new = text.isNotNull() & ~text.isin(found[c]) if found[c] else text.isNotNull()
            aggs.append(F.min_by(text, F.when(new, pos)).alias(str(i)))
        row = df.agg(*aggs).first()
        still = []
        for i, c in enumerate(open_columns):
            if row[i] is not None:
                found[c].append(row[i])
                still.append(c)
        open_columns = still
    return found


def column_profile(df: DataFrame, order: list[str], names: dict[str, str] | None = None) -> DataFrame:
    """One row per column: position, name, original name, type, role and the first samples."""
    names = names or {c: c for c in df.columns}
    samples = first_distinct(df, df.columns, order)
    text_columns = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    text_types = infer_types(df, text_columns) if text_columns else {}
    rows = [
        (i, names[f.name], f.name,
         text_types[f.name] if isinstance(f.dataType, T.StringType) else declared_type(f.dataType),
         samples[f.name])
        for i, f in enumerate(df.schema)
    ]
    spark = df.sparkSession
    meta = spark.createDataFrame(
        rows, "position int, name string, original_name string, type string, samples array<string>"
    )
    return meta.select(
        "position", "name", "original_name", "type",
        column_role(F.col("name"), F.col("type")).alias("role"), "samples",
    )


# Descriptions -------------------------------------------------------------

def heuristic_summary(sheet: Column, columns: Column, num_rows: Column) -> Column:
    shown = F.array_join(F.slice(columns, 1, 10), ", ")
    return F.concat(
        F.lit("Structured data table '"), sheet, F.lit("' containing columns: "), shown,
        F.lit(". "), num_rows.cast("string"), F.lit(" rows."),
    )


def heuristic_keywords(sheet: Column, columns: Column) -> Column:
    return F.array_join(F.concat(F.array(sheet), F.slice(columns, 1, 5)), ", ")


def fast_summary(num_rows: Column, num_columns: Column) -> Column:
    return F.concat(
        F.lit("Sheet with "), num_rows.cast("string"), F.lit(" rows and "),
        num_columns.cast("string"), F.lit(" columns"),
    )


FAST_CATEGORY = "General"


def fast_keywords(columns: Column) -> Column:
    return F.array_join(F.slice(columns, 1, 5), ", ")


def csv_file_summary(file_name: Column, sheet_names: Column) -> Column:
    return F.concat(
        F.lit("Financial file '"), file_name, F.lit("' containing "), F.size(sheet_names).cast("string"),
        F.lit(" sheets: "), F.array_join(sheet_names, ", "), F.lit("."),
    )


def csv_file_keywords(extension: Column, file_name: Column) -> Column:
    return F.concat(F.lit("finance, "), extension, F.lit(", "), file_name)


def paged_file_summary(pages: DataFrame, file_key: str, file_name: str) -> DataFrame:
    """Summary and keywords of page files from rows (file, page_number, page_text).

    Only the first three pages of a file are ever brought together, cut to the
    length the preview can use; the page count is a plain count.
    """
    counts = pages.groupBy(file_key, file_name).agg(F.count(F.lit(1)).alias("num_pages"))
    # The rank filter lets Spark keep three rows per file and task before the shuffle.
    rank = pages.withColumn("_rank", F.row_number().over(Window.partitionBy(file_key).orderBy("page_number")))
    head = (
        rank.where("_rank <= 3").groupBy(file_key)
        .agg(F.array_sort(F.collect_list(F.struct("_rank", F.left("page_text", F.lit(2000)).alias("t")))).alias("_p"))
        .select(file_key, F.left(F.array_join(F.col("_p.t"), " "), F.lit(200)).alias("_preview"))
    )
    name = F.col(file_name)
    return counts.join(head, file_key).select(
        file_key, file_name, "num_pages",
        F.concat(F.lit("PDF Document '"), name, F.lit("' containing "), F.col("num_pages").cast("string"),
                 F.lit(" pages. Preview: "), F.col("_preview"), F.lit("...")).alias("summary"),
        F.concat(F.lit("PDF, "), name, F.lit(", Document")).alias("keywords"),
    )


def word_table_summary(index: Column, columns: Column) -> Column:
    return F.concat(
        F.lit("Table "), index.cast("string"), F.lit(" with columns: "),
        F.array_join(F.slice(columns, 1, 5), ", "),
    )


def columns_text(sheet: Column, metadata: Column) -> Column:
    """The searchable description of a sheet's columns, one line each."""
    lines = F.transform(metadata, lambda m: F.concat(
        F.lit("Column: "), m["name"], F.lit(" (Original: "), m["original_name"], F.lit(") - Samples: "),
        F.array_join(m["samples"], ", "), F.lit("\n"),
    ))
    return F.concat(F.lit("Sheet: "), sheet, F.lit("\n"), F.array_join(lines, ""))
