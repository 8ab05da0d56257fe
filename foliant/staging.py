"""Logical tables projected from the driver's Parquet tables.

Each view has a twin SQL fragment in ``foliant.plans.sql`` so that queries and their
checks start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.schemas import epoch_micros

TITLE_WORDS = 6


# Ids made of two: the first times this, plus the second.  Neither part can run into the other,
# and beyond a long the sum is an error, not another row's id.
ID_ROOM = 1 << 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Share a small input out over all cores ahead of CPU-heavy stages.

    Large inputs already have more splits than cores and pass through untouched, so no
    shuffle is added where it would cost anything.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def page_title(text: Column) -> Column:
    """Opening words of the first line stand in for the page title."""
    first = F.split_part(text, F.lit("\n"), F.lit(1))
    return F.array_join(F.slice(F.split(first, " "), 1, TITLE_WORDS), " ")


def pages_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown pages: bucket, title, language, text and reliability status."""
    # The title is cut before the join, so jobs that need no text shuffle none.
    pages = pages_plain(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "page_id")
    status = (
        F.when(F.col("toxic") == 1, "community_theory")
        .when(F.col("quality") == 0, "speculation")
        .otherwise("canon")
    )
    return pages.join(labels, "page_id", "left").select(
        "page_id", "bucket_id", "page_title", "lang", "content_markdown",
        status.alias("canon_status"))


def pages_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages without the status: no join, for jobs that only need text."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("page_id"),
        F.col("source").alias("bucket_id"),
        page_title(F.col("text")).alias("page_title"),
        "lang",
        F.col("text").alias("content_markdown"),
    )


def wikitext(text: Column) -> Column:
    """Wiki markup derived from a plain text: twelve markup shapes by line position."""

    def mark(line: Column, i: Column) -> Column:
        words = F.split(line, " ")
        w0, w1 = F.get(words, F.lit(0)), F.coalesce(F.get(words, F.lit(1)), F.lit("x"))
        k = i % 12
        rest = F.array_join(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), " ")
        nl = F.lit("\n")
        cat = F.concat
        lit = F.lit
        return (
            F.when(k == 0, cat(lit("== "), w0, lit(" "), w1, lit(" =="), nl, line))
            .when(k == 1, cat(lit("'''"), w0, lit("''' "), rest))
            .when(k == 2, cat(lit("* "), w0, lit(": "), line))
            .when(k == 3, cat(lit("[["), w0, lit("|"), w1, lit("]] [["), w1, lit("#s]] "), line))
            .when(k == 4, cat(lit("{{Quote|"), line, lit("|"), w0, lit("}}")))
            .when(k == 5, cat(lit("=== Acquisition ==="), nl, line))
            .when(k == 6, cat(lit("== Lore =="), nl, line))
            .when(k == 7, cat(lit("<!-- "), w0, lit(" --><b>"), w0, lit("</b><br/>"), line,
                              lit("<ref>n</ref>")))
            .when(k == 8, cat(lit(":: "), line, lit(" [https://example.org/p "), w0, lit("]")))
            .when(k == 9, cat(lit("{{Speculation|"), w0, lit("}}"), nl, line))
            .when(k == 10, cat(lit('{| class="t"'), nl, lit("| "), w0, nl, lit("|}"), nl, line))
            .otherwise(cat(nl, lit("''"), w0, lit("'' "), line, lit(" clip_one.ogg")))
        )

    lines = F.split(text, "\n")
    return F.array_join(F.transform(lines, mark), "\n")


def wiki_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(
        F.col("doc_id").alias("page_id"),
        page_title(F.col("text")).alias("page_title"),
        wikitext(F.col("text")).alias("wikitext"),
    )


def structured_markdown(text: Column) -> Column:
    """Markdown with a heading hierarchy derived from the line positions."""

    def mark(line: Column, i: Column) -> Column:
        words = F.split(line, " ")
        w0, w1 = F.get(words, F.lit(0)), F.coalesce(F.get(words, F.lit(1)), F.lit("x"))
        head = F.concat(w0, F.lit(" "), w1)
        return (
            F.when(i % 9 == 1, F.concat(F.lit("## "), head, F.lit("\n"), line))
            .when(i % 9 == 4, F.concat(F.lit("### "), head, F.lit("\n"), line))
            .when(i % 9 == 6, F.concat(F.lit("#### "), head, F.lit("\nend.")))
            .when(i % 9 == 8, F.concat(F.lit("## Short\nok.\n\n"), line))
            .otherwise(line)
        )

    return F.array_join(F.transform(F.split(text, "\n"), mark), "\n")


def sectioned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return docs.select(
        F.col("doc_id").alias("page_id"),
        F.col("source").alias("bucket_id"),
        page_title(F.col("text")).alias("page_title"),
        structured_markdown(F.col("text")).alias("content_markdown"),
    )


def dialogue_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as dialogue lines of a page."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("page_id"),
        F.col("turn").alias("message_order"),
        F.col("role").alias("speaker"),
        (F.col("role") == "user").alias("player_choice"),
        F.col("text").alias("message_text"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message stream with integer microseconds instead of a zoned timestamp."""
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value", "props",
        epoch_micros("ts").alias("us"))
