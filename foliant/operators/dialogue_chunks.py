"""Dialogue chunking: whole lines packed to a size, speakers kept with each chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import messages as M
from foliant.operators import chunks, ordered
from foliant.operators.packing import pack


def render_lines(lines: DataFrame) -> DataFrame:
    """Quoted line of each message, one text line per message."""
    said = F.regexp_replace("message_text", r"\s*\n\s*", " ")
    return lines.select("page_id", "message_order", F.col("speaker"), F.concat(
        F.lit("> **"), "speaker", F.lit(":** "), said).alias("line"))


def dialogue_chunks(lines: DataFrame, max_chars: int = chunks.DIALOGUE_MAX_CHARS,
                    overlap_chars: int = chunks.DIALOGUE_OVERLAP_CHARS) -> DataFrame:
    """Chunks of (page_id, message_order, speaker, line).

    A line longer than a chunk stands alone, cut hard with overlap, and forgets the
    speakers before it; every other chunk carries the speakers met since then.
    """
    packed = pack(lines, ["page_id"], ["message_order"], F.length("line") + 1, max_chars)
    named = F.when(M.is_speaker_strict(F.col("speaker")), F.col("speaker"))
    members = lines.withColumn("speaker", named).join(packed, ["page_id", "message_order"])
    groups = members.groupBy("page_id", "group_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
            "message_order", "line"))), lambda r: r["line"]), "\n").alias("text"),
        F.max(F.length("line") + 1).alias("longest"))
    keys, order, slot = ["page_id"], ["group_no"], F.floor(F.col("group_no") / 4096)
    alone = F.col("longest") > max_chars
    groups = groups.withColumn("pieces", F.when(
        alone, chunks.hard_pieces(F.col("text"), max_chars, overlap_chars)
    ).otherwise(F.array("text"))).withColumn("alone", alone).drop("text", "longest")
    groups = ordered.running_sum(groups, keys, order, slot, {"first_chunk": F.size("pieces")},
                                 inclusive=False)
    groups = ordered.running_sum(groups, keys, order, slot,
                                 {"run": F.when(F.col("alone"), 1).otherwise(0)})
    # A stand-alone chunk is a run of its own; the chunks after it share the next one.
    run = F.col("run") * 2 - F.when(F.col("alone"), 1).otherwise(0)
    groups = groups.withColumn("run", run)

    where = groups.select("page_id", "group_no", "run")
    firsts = members.filter("speaker IS NOT NULL").join(where, ["page_id", "group_no"]).groupBy(
        "page_id", "run", "speaker").agg(
        F.min("group_no").alias("since"), F.min("message_order").alias("met"))
    heard = where.join(firsts, ["page_id", "run"]).filter("since <= group_no").groupBy(
        "page_id", "group_no").agg(F.transform(F.array_sort(F.collect_list(F.struct(
            "met", "speaker"))), lambda r: r["speaker"]).alias("speakers"))
    done = groups.join(heard, ["page_id", "group_no"], "left")
    return done.select(
        "page_id", "first_chunk", F.coalesce("speakers", F.array().cast("array<string>"))
        .alias("speakers"), F.posexplode("pieces").alias("piece_no", "content")).select(
        "page_id", (F.col("first_chunk") + F.col("piece_no")).alias("chunk_index"),
        F.concat(F.lit("Page: "), F.col("page_id").cast("string"), F.lit("\n"), "content")
        .alias("content_markdown"), "speakers")
