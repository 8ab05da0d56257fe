"""Corpus exports: bucket documents, parts under a word budget, one merged document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators.corpus import render_page
from foliant.operators.packing import pack

# Word budget of a part, and the size above which a source is oversize.
PART_WORDS, MAX_WORDS = 400_000, 500_000


def rendered(pages: DataFrame) -> DataFrame:
    """Export block of every page; writing it sorted by (bucket, title) gives one document."""
    return pages.select("bucket_id", "page_title", "page_id", render_page(
        F.col("page_title"), F.col("bucket_id"), F.col("canon_status"),
        F.col("content_markdown")).alias("block"))


def export_parts(pages: DataFrame, max_words: int = PART_WORDS) -> DataFrame:
    """Part number of each page: parts fill up to the word budget on page boundaries."""
    blocks = rendered(pages).withColumn("words", T.word_count(F.col("block")))
    return pack(blocks, ["bucket_id"], ["page_id"], F.col("words"), max_words, keep=["words"])


def part_manifest(parts: DataFrame, max_words: int = PART_WORDS,
                  oversize: int = MAX_WORDS) -> DataFrame:
    """One row per part: file name, label, pages, words and size flag."""
    per_part = parts.groupBy("bucket_id", "group_no").agg(
        F.count("*").alias("pages"), F.sum("words").alias("words"))
    totals = per_part.groupBy("bucket_id").agg(F.count("*").alias("parts"))
    j = per_part.join(totals, "bucket_id")
    no = (F.col("group_no") + 1).cast("string")
    many = F.col("parts") > 1
    slug = F.replace(F.replace(F.col("bucket_id"), F.lit(" "), F.lit("_")), F.lit("/"), F.lit("-"))
    return j.select(
        "bucket_id", "group_no", "pages", "words",
        F.when(many, F.concat(slug, F.lit("_part"), no, F.lit(".md"))).otherwise(
            F.concat(slug, F.lit(".md"))).alias("file_name"),
        F.when(many, F.concat("bucket_id", F.lit(" (part "), no, F.lit("/"),
                              F.col("parts").cast("string"), F.lit(")"))).otherwise(
            F.col("bucket_id")).alias("label"),
        F.when(F.col("words") > oversize, "OVERSIZE").when(F.col("words") > max_words, "LARGE")
        .otherwise("").alias("flag"))


def megafile_parts(pages: DataFrame, pages_per_file: int) -> DataFrame:
    """File number of each page in its bucket, pages in title order.

    A bucket of any size becomes several bounded documents instead of one.
    """
    return pack(pages, ["bucket_id"], ["page_title", "page_id"], F.lit(1), pages_per_file)


def megafile_documents(pages: DataFrame, parts: DataFrame, generated_at: str) -> DataFrame:
    """One JSON document per (bucket, file): metadata header and pages sorted by title."""
    entry = F.struct("page_title", F.col("page_id").alias("_pageid"), "canon_status",
                     "content_markdown", "bucket_id")
    joined = pages.join(parts.select("page_id", "group_no"), "page_id")
    return joined.groupBy("bucket_id", "group_no").agg(
        F.array_sort(F.collect_list(entry)).alias("pages")).select(
        "bucket_id", "group_no", F.to_json(F.struct(
            F.struct(F.col("bucket_id").alias("bucket_title"),
                     F.lit(generated_at).alias("generated_at"),
                     F.size("pages").cast("long").alias("total_pages")).alias("metadata"),
            "pages")).alias("document"))


def output_entry(pages: DataFrame) -> DataFrame:
    """Page entries as JSON: date cut to the day, null id left out, extra fields merged."""
    return pages.select("page_id", F.to_json(F.struct(
        "page_title", "category", F.substring("last_updated", 1, 10).alias("last_updated"),
        "canon_status", F.col("stored_id").alias("_pageid"), "lang"),
        {"ignoreNullFields": "true"}).alias("entry"))
