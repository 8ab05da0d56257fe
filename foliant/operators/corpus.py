"""Reports, listings and searches over the page corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T


def corpus_stats(pages: DataFrame) -> DataFrame:
    """Totals, per-status and per-bucket counts in one pass."""
    return pages.groupingSets(
        [["canon_status"], ["bucket_id"], []], "canon_status", "bucket_id"
    ).agg(
        F.grouping_id().alias("level"),
        F.count("*").alias("pages"),
        F.max("page_id").alias("last_page_id"),
    )


def status_counts() -> list[Column]:
    return [F.count("*").alias("pages"), *[
        F.count_if(F.col("canon_status") == s).alias(n)
        for s, n in (("canon", "canon"), ("speculation", "speculation"),
                     ("community_theory", "theory"))]]


def bucket_overview(pages: DataFrame) -> DataFrame:
    """Pages and status counts per bucket, with the corpus total as one more row."""
    return pages.rollup("bucket_id").agg(*status_counts()).withColumn(
        "bucket_id", F.coalesce("bucket_id", F.lit("(all)")))


def search(pages: DataFrame, needle: str, limit: int = 50, *, radius: int = 60,
           bucket: str | None = None, status: str | None = None,
           title_snippets: bool = True) -> DataFrame:
    """Title hits strictly before content hits, each by bucket then folded title."""
    needle = needle.strip().lower()
    hits = pages
    if bucket:
        hits = hits.filter(F.col("bucket_id") == bucket)
    if status:
        hits = hits.filter(F.col("canon_status") == status)
    in_title = F.contains(F.lower("page_title"), F.lit(needle))
    in_text = F.contains(F.lower("content_markdown"), F.lit(needle))
    ranked = hits.withColumn(
        "match_type", F.when(in_title, "title").when(in_text, "content")
    ).filter("match_type IS NOT NULL")
    top = ranked.orderBy(
        F.col("match_type").desc(), "bucket_id", F.lower("page_title"), "page_id").limit(limit)
    shown = T.snippet(F.col("content_markdown"), F.lit(needle), radius)
    if not title_snippets:
        shown = F.when(F.col("match_type") == "content", shown).otherwise(F.lit(""))
    return top.select("page_id", "bucket_id", "page_title", "canon_status", "match_type",
                      shown.alias("snippet"))


def name_presence(pages: DataFrame, names: Sequence[str]) -> DataFrame:
    """Pages whose title contains each name; names found nowhere count zero.

    The name list is configuration.  Each page emits the names it contains, so the
    corpus is read once and only counts are shuffled.
    """
    wanted = F.array(*[F.lit(n.lower()) for n in names])
    found = pages.select(F.explode(F.filter(
        wanted, lambda n: F.contains(F.lower("page_title"), n))).alias("name"))
    counts = found.groupBy("name").agg(F.count("*").alias("pages"))
    all_names = pages.sparkSession.createDataFrame(
        [(n.lower(),) for n in names], "name string")
    return all_names.join(counts, "name", "left").select(
        "name", F.coalesce("pages", F.lit(0)).alias("pages"))


def recent(df: DataFrame, newest: Sequence[Column], n: int) -> DataFrame:
    """The n newest rows by a total order (no full sort: each task keeps n)."""
    return df.orderBy(*newest).limit(n)


def latency_percentiles(samples: DataFrame, value: str, newest: Sequence[Column],
                        ratios: Sequence[float], last: int = 200) -> DataFrame:
    """Nearest-rank percentiles over the newest samples, half-even rounded."""
    window = samples.orderBy(*newest).limit(last)
    return window.agg(
        F.count("*").alias("samples"),
        *[F.bround(F.expr(f"percentile_disc({r}) WITHIN GROUP (ORDER BY {value})"), 2)
          .alias(f"p{round(r * 100)}") for r in ratios])


def merge_stats(pages: DataFrame, text: str, warn_words: int = 400_000) -> DataFrame:
    """Size of a merged export: characters, words, token estimate, warning flag."""
    return pages.agg(
        F.count("*").alias("pages"),
        F.sum(F.length(text)).alias("chars"),
        F.sum(T.word_count(F.col(text))).alias("words"),
    ).select("*", F.floor(F.col("chars") / 4).alias("tokens"),
             (F.col("words") > warn_words).alias("large"))


def chunk_audit(chunks: DataFrame, needle: str, first: int, excerpt: int = 80) -> DataFrame:
    """Total chunks, title matches, and the opening chunks with a collapsed excerpt."""
    totals = chunks.agg(
        F.count("*").alias("total_chunks"),
        F.count_if(F.contains(F.lower("page_title"), F.lit(needle))).alias("title_matches"))
    opening = chunks.orderBy("page_id", "chunk_index").limit(first).select(
        "page_id", "chunk_index",
        F.substring(T.squeeze(F.col("content")), 1, excerpt).alias("excerpt"))
    return opening.join(F.broadcast(totals), F.lit(True))  # totals: one row


def render_page(title: Column, category: Column, status: Column, content: Column) -> Column:
    """Export block of one page under its bucket heading."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("### "), title, F.lit("  _(category: "), category, F.lit(")_")),
        F.concat(F.lit("_canon_status: "), status, F.lit("_")),
        F.lit(""),
        F.nullif(T.strip(content), F.lit("")),
        F.lit(""), F.lit("---"), F.lit(""))
