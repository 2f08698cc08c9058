"""Catalogue schemas and the policy seed."""

from __future__ import annotations

from pyspark.sql import types as T

COLUMN_META = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("original_name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("samples", T.ArrayType(T.StringType())),
])

ENTITIES = T.StructType([
    T.StructField("amounts", T.ArrayType(T.StringType())),
    T.StructField("dates", T.ArrayType(T.StringType())),
    T.StructField("percentages", T.ArrayType(T.StringType())),
    T.StructField("companies", T.ArrayType(T.StringType())),
])

FILES = T.StructType([
    T.StructField("file_id", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("file_type", T.StringType()),
    T.StructField("uploaded_at", T.TimestampNTZType()),
    T.StructField("num_sheets", T.IntegerType()),
    T.StructField("num_pages", T.IntegerType()),
    T.StructField("summary", T.StringType()),
    T.StructField("keywords", T.StringType()),
    T.StructField("summary_embedding", T.ArrayType(T.FloatType())),
    T.StructField("keywords_embedding", T.ArrayType(T.FloatType())),
    T.StructField("version", T.IntegerType()),
    T.StructField("file_hash", T.StringType()),
])

SHEETS = T.StructType([
    T.StructField("sheet_id", T.StringType()),
    T.StructField("file_id", T.StringType()),
    T.StructField("sheet_name", T.StringType()),
    T.StructField("table_name", T.StringType()),
    T.StructField("num_rows", T.LongType()),
    T.StructField("num_columns", T.IntegerType()),
    T.StructField("category", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("keywords", T.StringType()),
    T.StructField("summary_embedding", T.ArrayType(T.FloatType())),
    T.StructField("keywords_embedding", T.ArrayType(T.FloatType())),
    T.StructField("columns_metadata", T.ArrayType(COLUMN_META)),
    T.StructField("data_domain", T.StringType()),
    T.StructField("sensitivity_level", T.StringType()),
])

CHUNKS = T.StructType([
    T.StructField("chunk_id", T.StringType()),
    T.StructField("file_id", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("page_number", T.IntegerType()),
    T.StructField("chunk_index", T.IntegerType()),
    T.StructField("chunk_text", T.StringType()),
    T.StructField("entities", ENTITIES),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

POLICIES = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("data_domain", T.StringType()),
    T.StructField("sensitivity_level", T.StringType()),
    T.StructField("allowed", T.BooleanType()),
    T.StructField("allow_aggregation", T.BooleanType()),
    T.StructField("allow_raw_rows", T.BooleanType()),
])

CELLS = T.StructType([
    T.StructField("file_id", T.StringType()),
    T.StructField("sheet", T.StringType()),
    T.StructField("row", T.LongType()),
    T.StructField("col", T.IntegerType()),
    T.StructField("value", T.StringType()),
])

# The default policies.
POLICY_SEED = [
    ("CEO", "finance", "confidential", True, True, True),
    ("CEO", "hr", "confidential", True, True, True),
    ("Finance_Manager", "finance", "confidential", True, True, True),
    ("Finance_Manager", "hr", "confidential", False, False, False),
    ("Analyst", "finance", "confidential", True, True, False),
    ("Employee", "finance", "internal", True, True, False),
]
