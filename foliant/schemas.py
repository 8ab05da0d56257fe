"""Logical tables of the knowledge base and the constraints Parquet does not enforce."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("page_title", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("namespace", T.IntegerType()),
    T.StructField("last_updated", T.TimestampType()),
    T.StructField("touched", T.StringType()),
    T.StructField("canon_status", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("content_markdown", T.StringType()),
])

RAW_PAGE = T.StructType([
    T.StructField("pageid", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("namespace", T.IntegerType()),
    T.StructField("touched", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("content", T.StringType()),
])

CHUNK = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("chunk_index", T.IntegerType()),
    T.StructField("content_markdown", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

DIALOGUE = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("message_order", T.IntegerType()),
    T.StructField("dialogue_kind", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("chapter", T.StringType()),
    T.StructField("speaker", T.StringType()),
    T.StructField("message_text", T.StringType()),
    T.StructField("player_choice", T.BooleanType()),
    T.StructField("chemistry_gain", T.BooleanType()),
])

ENTITY = T.StructType([
    T.StructField("entity_id", T.StringType()),
    T.StructField("entity_type", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
])

MEGAFILE_PAGE = T.StructType([
    T.StructField("page_title", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("last_updated", T.StringType()),
    T.StructField("canon_status", T.StringType()),
    T.StructField("content_markdown", T.StringType()),
    T.StructField("bucket_id", T.StringType()),
    T.StructField("page_url", T.StringType()),
    T.StructField("_source", T.StringType()),
    T.StructField("_pageid", T.LongType()),
])

MEGAFILE = T.StructType([
    T.StructField("metadata", T.StructType([
        T.StructField("bucket_title", T.StringType()),
        T.StructField("generated_at", T.StringType()),
        T.StructField("total_pages", T.LongType()),
        T.StructField("source_api", T.StringType()),
        T.StructField("note", T.StringType()),
    ])),
    T.StructField("pages", T.ArrayType(MEGAFILE_PAGE)),
])

# Enumerations a CHECK clause would hold (fixed values).
CANON_STATUSES = ("canon", "speculation", "community_theory")
DIALOGUE_KINDS = ("chat", "cinematic", "quote")
VERDICTS = ("up", "down")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows breaking a UNIQUE constraint: one row per key with its count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows breaking a foreign key: the child rows without a parent."""
    parents = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.join(parents, child_key, "left_anti")


def out_of_domain(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Rows breaking a CHECK enumeration (nulls pass, as in SQL)."""
    return df.filter(~F.col(column).isin(*allowed))


def count_violations(checks: Mapping[str, DataFrame]) -> DataFrame:
    """One row per named check with its number of violating rows."""
    rows = None
    for name, bad in checks.items():
        one = bad.agg(F.count("*").alias("violations")).select(
            F.lit(name).alias("check_name"), "violations")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def epoch_micros(column: Column | str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    c = F.col(column) if isinstance(column, str) else column
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            c.cast("timestamp_ntz"))
