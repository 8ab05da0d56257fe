"""The full update chain, and the table-function form of the text splitter."""

from __future__ import annotations


from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from foliant import staging
from foliant.functions import embedding as EMB
from foliant.functions import wikitext as X
from foliant.operators import chunks, extract, sync
from foliant.plans.clean import chat_pages
from foliant.plans.extract import structured_rows
from foliant.plans.registry import query
from foliant.plans.sync import live_state, stored_state
from foliant.session import materialize


@query("split_chunks_sql")
def split_chunks_sql(spark, sf):
    """The splitter as SQL sees it: an array column, unnested by LATERAL VIEW."""
    docs = staging.spread(staging.table(spark, sf, "documents").select("doc_id", "text"))
    docs.withColumn("pieces", chunks.split_column(F.col("text"))).createOrReplaceTempView(
        "foliant_split_input")
    return spark.sql(
        "SELECT doc_id AS page_id, piece_no, piece FROM foliant_split_input "
        "LATERAL VIEW posexplode(pieces) p AS piece_no, piece")


@query("chunk_page_join", """
SELECT l.conv_id AS page_id, l.turn AS message_order, d.source AS bucket_id, d.lang FROM conversations l
JOIN documents d ON l.conv_id = d.doc_id""")
def chunk_page_join(spark, sf):
    """Derived rows with the columns of their page."""
    lines = staging.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("page_id"), F.col("turn").alias("message_order"))
    pages = staging.table(spark, sf, "documents").select(
        F.col("doc_id").alias("page_id"), F.col("source").alias("bucket_id"), "lang")
    return lines.join(pages, "page_id")


def run_update(spark, sf) -> DataFrame:
    """All phases in order, one row of counts per phase.

    Each phase writes its result (here: a checkpoint) before the next reads it; the counts
    are observed while the phase runs, not recounted.
    """
    counts = []

    def phase(name: str, df: DataFrame) -> DataFrame:
        seen = Observation()
        done = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")))
        counts.append((name, int(seen.get["n"])))
        return done

    plan = phase("sync", sync.delta_plan(live_state(spark, sf), stored_state(spark, sf),
                                         ["bucket_id", "page_id"]))
    acknowledged = plan.select("bucket_id", "page_id", "touched")
    pages = phase("pages", X.clean_pages(staging.wiki_pages(spark, sf)).filter(
        F.length("markdown") >= 20).select(
        "page_id", "page_title", F.col("markdown").alias("content_markdown")))
    phase("dialogues", extract.dialogue_rows(chat_pages(spark, sf)))
    pieces = phase("chunks", chunks.chunk_pages(pages).select(
        (F.col("page_id") * staging.ID_ROOM + F.col("chunk_index")).alias("chunk_id"),
        F.col("content_markdown").alias("content"), F.lit(None).cast("array<float>").alias("embedding")))
    phase("embeddings", EMB.backfill(pieces, EMB.hashed_terms()))
    phase("structured", EMB.backfill(structured_rows(spark, sf).withColumn(
        "embedding", F.lit(None).cast("array<float>")), EMB.hashed_terms()))
    phase("acknowledged", sync.upsert(stored_state(spark, sf), acknowledged, ["bucket_id", "page_id"]))
    return spark.createDataFrame(counts, "phase string, n long")


@query("update_chain")
def update_chain(spark, sf):
    return run_update(spark, sf)


