"""Chat formatting: every participant's view of a dialogue, with that speaker as the assistant.

For each participant the dialogue is rendered once: the participant's turns as the assistant's,
the others' as turns of named users, system turns as they are.  The spans of the assistant's
turns are what a model is to learn; everything else is masked.  DataFrame functions only.

A dialogue of any length is handled in parts of PART turn numbers, each a row, so that no task
holds more than a part; parts follow each other and put together give the whole rendering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = 256  # turn numbers in a part
SYSTEM = "system"
UNNAMED = "unknown"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _plain(text: Column) -> Column:
    """Text that cannot be taken for a marker."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|(im_start|im_end)\|>", "<$1>")


def perspectives(turns: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, speaker, part, n_turns, n_own, text, spans) from (conv_id, turn, role, text).

    One row for every dialogue, participant and part.  Participants are the roles of a dialogue
    but for ``system``; a role that is null or blank is the participant ``unknown``.  Turns are
    rendered in order of turn, then role, then text, so repeated rows stay and ties have an
    order.  ``spans`` holds the places of the participant's own turns (end marker included) in
    ``text`` as ``start-stop`` in characters, joined by a space; n_own is their number.  A null
    text is an empty turn, a null turn comes first (part -1), and rows without a conv_id are one
    dialogue of their own.  A dialogue of system turns alone has no participant and no row; an
    empty table gives an empty result.  Marker strings within a text lose their bars.
    """
    role = F.trim(F.col("role").cast("string"))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(F.coalesce(role, F.lit("")) == "", F.lit(UNNAMED)).otherwise(role).alias("role"),
        _plain(F.col("text").cast("string")).alias("text"))
    rows = rows.withColumn("part", F.coalesce(F.floor(F.col("turn") / part), F.lit(-1)))
    speakers = rows.filter(F.col("role") != SYSTEM).select(
        F.col("conv_id").alias("of"), F.col("role").alias("speaker")).distinct()
    seen = rows.join(speakers, F.col("conv_id").eqNullSafe(F.col("of")))
    packed = seen.groupBy("conv_id", "speaker", "part").agg(F.array_sort(F.collect_list(
        F.struct("turn", "role", "text"))).alias("turns"))
    own = lambda t: t["role"] == F.col("speaker")
    head = lambda t: (
        F.when(own(t), F.lit("assistant"))
        .when(t["role"] == SYSTEM, F.lit("system"))
        .otherwise(F.concat(F.lit("user name="), t["role"])))
    shown = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(OPEN), head(t), F.lit("\n")).alias("head"),
        F.concat(t["text"], F.lit(CLOSE)).alias("body"), own(t).alias("own")))
    shown_rows = packed.select("conv_id", "speaker", "part", shown.alias("turns"))
    # A span begins after the turn's head and ends with its end marker.
    spans = F.aggregate(
        "turns", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("spans")),
        lambda state, t: F.struct(
            (state["at"] + F.length(t["head"]) + F.length(t["body"]) + 1).alias("at"),
            F.concat(state["spans"], F.when(t["own"], F.concat(
                F.lit(" "), (state["at"] + F.length(t["head"])).cast("string"), F.lit("-"),
                (state["at"] + F.length(t["head"]) + F.length(t["body"])).cast("string")))
                .otherwise(F.lit(""))).alias("spans")),
        lambda state: F.trim(state["spans"]))
    return shown_rows.select(
        "conv_id", "speaker", "part", F.size("turns").alias("n_turns"),
        F.size(F.filter("turns", lambda t: t["own"])).alias("n_own"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit("\n"))),
                     "").alias("text"), spans.alias("spans"))
