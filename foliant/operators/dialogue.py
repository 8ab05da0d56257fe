"""Dialogue lines: parent links, markers, speakers, references and conversation graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators import ordered

# Lines of one page per slot; a page of any length spreads over its slots.
SLOT_LINES = 4096
KEY, ORDER = ["page_id"], ["message_order"]


def line_slot(column: str = "message_order") -> Column:
    return F.floor(F.col(column) / SLOT_LINES)


def parent_links(lines: DataFrame) -> DataFrame:
    """Parent line of each line.

    A spoken line hangs on the line before it; every line of a run of choices hangs on
    the last line before the run; the opening line has no parent.
    """
    prev = F.struct(F.col("message_order").alias("at"), F.col("player_choice").alias("choice"))
    d = ordered.carry(lines, KEY, ORDER, line_slot(), {"__prev": prev}, inclusive=False)
    opens = F.col("player_choice") & ~F.coalesce(F.col("__prev.choice"), F.lit(False))
    d = ordered.carry(d, KEY, ORDER, line_slot(), {
        "__run": F.when(opens, F.struct(F.col("__prev.at").alias("at")))})
    return d.withColumn(
        "parent_order",
        F.when(F.col("player_choice"), F.col("__run.at")).otherwise(F.col("__prev.at")),
    ).drop("__prev", "__run")


def accepted_positions(lines: DataFrame, accepted: Column) -> DataFrame:
    """0-based order of the accepted lines."""
    return ordered.positions(lines.filter(accepted), KEY, ORDER, line_slot(), "position")


def credit_markers(lines: DataFrame, is_marker: Column) -> DataFrame:
    """Messages with a flag set by marker lines that follow them directly.

    Markers before the first message have nothing to credit and drop out.
    """
    numbered = ordered.running_sum(
        lines.withColumn("is_marker", is_marker), KEY, ORDER, line_slot(),
        {"message_no": F.when(F.col("is_marker"), 0).otherwise(1)})
    credited = numbered.filter("is_marker AND message_no > 0").select(
        "page_id", "message_no").distinct().withColumn("credited", F.lit(True))
    return numbered.filter("NOT is_marker").join(
        credited, ["page_id", "message_no"], "left").withColumn(
        "credited", F.coalesce("credited", F.lit(False))).drop("is_marker")


def speakers_in_order(lines: DataFrame) -> DataFrame:
    """Speakers of each page in order of first appearance, with page totals."""
    firsts = lines.groupBy("page_id", "speaker").agg(
        F.min("message_order").alias("at"), F.count("*").alias("n"),
        F.count_if("player_choice").alias("choices"))
    return firsts.groupBy("page_id").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("at", "speaker"))), lambda s: s["speaker"]),
            ", ").alias("speakers"),
        F.sum("n").alias("line_count"), F.sum("choices").alias("choice_count"))


def jump_targets(lines: DataFrame, key: Column) -> DataFrame:
    """Line a jump reference leads to: first line with the key, and the next one after."""
    d = lines.withColumn("ref_key", key)
    first = d.groupBy("page_id", "ref_key").agg(F.min("message_order").alias("first_target"))
    nxt = ordered.carry(d, ["page_id", "ref_key"], ORDER, line_slot(),
                        {"next_target": F.col("message_order")}, inclusive=False, backward=True)
    return nxt.join(first, ["page_id", "ref_key"])


def conversation_graph(lines: DataFrame, is_terminal: Column) -> DataFrame:
    """Edges of a dialogue: narration chain, choices, and their return to the narration.

    * a spoken line leads to the next spoken line unless choices stand between them or the
      line ends the conversation;
    * a choice hangs on the last spoken line, terminal or not; a choice before any spoken
      line hangs on the choice before it;
    * every choice leads to the next spoken line, unless it is terminal itself.
    """
    d = lines.withColumn("terminal", is_terminal)
    at = F.col("message_order")
    spoken = F.when(~F.col("player_choice"), F.struct(at.alias("at"), F.col("terminal")))
    prev = F.struct(at.alias("at"), F.col("player_choice").alias("choice"), F.col("terminal"))
    back = ordered.carry(d, KEY, ORDER, line_slot(), {"npc": spoken, "prev": prev},
                         inclusive=False)
    both = ordered.carry(back, KEY, ORDER, line_slot(),
                         {"next_npc": F.when(~F.col("player_choice"), at)},
                         inclusive=False, backward=True)

    def edges(rows, source, target, rule):
        return rows.select("page_id", source.alias("source"), target.alias("target"),
                           F.lit(rule).alias("rule"))

    chain = edges(both.filter("NOT player_choice AND prev IS NOT NULL AND NOT prev.choice "
                              "AND NOT prev.terminal"),
                  F.col("prev.at"), at, "chain")
    options = edges(both.filter("player_choice AND npc IS NOT NULL"),
                    F.col("npc.at"), at, "choice")
    leading = edges(both.filter("player_choice AND npc IS NULL AND prev IS NOT NULL "
                                "AND NOT prev.terminal"),
                    F.col("prev.at"), at, "choice")
    rejoin = edges(both.filter("player_choice AND next_npc IS NOT NULL AND NOT terminal"),
                   at, F.col("next_npc"), "rejoin")
    return chain.unionByName(options).unionByName(leading).unionByName(rejoin)


def attach_root(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges from one synthetic root per page to native starts and nodes nothing leads to."""
    targets = edges.select("page_id", F.col("target").alias("node")).distinct()
    free = nodes.select("page_id", "node").join(targets, ["page_id", "node"], "left_anti")
    starts = nodes.filter("is_start").select("page_id", "node")
    return free.union(starts).distinct().select(
        "page_id", F.lit("root").alias("source"), F.col("node").alias("target"))


def merge_tables(source: DataFrame, target: DataFrame, keys: list[str],
                 columns: list[str]) -> DataFrame:
    """Target after an upsert from source: the source's value wins where it has a row."""
    s = source.select(*keys, F.struct(*columns).alias("s"))
    t = target.select(*keys, F.struct(*columns).alias("t"))
    return s.join(t, keys, "full_outer").select(
        *keys, *[F.when(F.col("s").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
                 for c in columns],
        F.when(F.col("s").isNull(), "kept").when(F.col("t").isNull(), "inserted")
        .otherwise("updated").alias("action"))
