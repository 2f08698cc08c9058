"""Cleaning of numbers, dates and empty cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Date forms read after the ISO forms, month before day.
DATE_FORMATS = ("M/d/yyyy", "yyyy/M/d", "MMM d, yyyy", "d MMM yyyy")


def clean_number(text: Column) -> Column:
    """Money text to double: only digits, dot and minus count; unreadable is 0."""
    return F.coalesce(F.regexp_replace(text, r"[^\d.-]", "").try_cast("double"), F.lit(0.0))


def metric_value(df: DataFrame, name: str) -> Column:
    """A metric column as a number: numeric types as they are, text through ``clean_number``; null and NaN count as 0."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.coalesce(F.nanvl(F.col(name), F.lit(0).cast(dtype)), F.lit(0).cast(dtype))
    if isinstance(dtype, T.NumericType):
        return F.coalesce(F.col(name), F.lit(0).cast(dtype))
    return clean_number(F.col(name).cast("string"))


def clean_date(text: Column) -> Column:
    """Date text to a zone-free timestamp, null when unreadable; four digits are a year."""
    t = F.trim(text)
    readings = [t.try_cast("timestamp_ntz")]
    readings += [F.try_to_date(t, f).cast("timestamp_ntz") for f in DATE_FORMATS]
    return F.coalesce(*readings)


def time_value(df: DataFrame, name: str) -> Column:
    """A time column as a zone-free timestamp; whole numbers of four digits are years."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return F.col(name).cast("timestamp_ntz")
    return clean_date(F.col(name).cast("string"))


def strip_nul(text: Column) -> Column:
    return F.regexp_replace(text, r"\x00", "")


def is_blank(text: Column) -> Column:
    """Null, empty, or white space of any script alone."""
    return text.isNull() | ~text.rlike(r"(?U)[^\s\x1c-\x1f]")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating columns becomes null."""
    return df.select(*[
        F.nullif(F.col(f.name), F.lit(float("nan")).cast(f.dataType)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema
    ])


def drop_empty(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop rows, then columns, that hold nothing but nulls and NaN (``keep`` columns do not count); NaN becomes null."""
    data = [c for c in df.columns if c not in keep]
    rows = nan_to_null(df).dropna(how="all", subset=data)
    filled = rows.agg(*[F.count(c).alias(c) for c in data]).first()
    return rows.select(*keep, *[c for c in data if filled[c] > 0])
