"""Link graphs and native conversation graphs."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from foliant.operators import ordered
from foliant.session import materialize


def reachable(edges: DataFrame, seeds: DataFrame, max_nodes: int | None = None) -> DataFrame:
    """Nodes reachable from the seeds, with their distance: breadth-first, one join a round.

    ``edges`` has source and target, ``seeds`` node.  Each round is written to the shared
    checkpoint folder, so the plan stays short and a lost executor costs one round.
    ``max_nodes`` caps the result in (distance, node) order.
    """
    links = materialize(edges.select(F.col("source").alias("node"), "target").distinct())
    frontier = materialize(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    known = frontier
    for depth in itertools.count(1):
        step = frontier.join(links, "node").select(F.col("target").alias("node")).distinct()
        frontier = materialize(step.join(known.select("node"), "node", "left_anti").withColumn(
            "depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
        if depth % 8 == 0:
            known = materialize(known)
        if max_nodes is not None and known.count() >= max_nodes:
            break
    if max_nodes is not None:
        known = known.orderBy("depth", "node").limit(max_nodes)
    return known


# Engine node types and their roles.
ENGINE = "/EE/Types/Engine/"
NODE_KINDS = {
    "StartDialogueNode": "start", "DialogueNode": "npc", "PlayerChoiceDialogueNode": "choice",
    "ChemistryDialogueNode": "chemistry", "EndDialogueNode": "end",
}

NODE = ("struct<Id:int,type:string,Content:string,LocTag:string,Speaker:string,"
        "ChemistryDelta:int,Outgoing:array<int>,TrueNodes:array<int>,FalseNodes:array<int>,"
        "Outputs:array<struct<Expression:string,Outgoing:array<int>>>,"
        "Script:struct<Script:string,Function:string>,CounterName:string,CompletionType:string,"
        "OtherDialogueInfos:array<struct<Tag:string,Dialogue:string>>>")


def node_kind(node_type: Column) -> Column:
    """Role of a node; only the exact engine types have one, look-alikes are system nodes."""
    return F.coalesce(*[F.when(node_type == ENGINE + t, F.lit(k)) for t, k in NODE_KINDS.items()],
                      F.lit("system"))


def _system_text(n: Column, said: Column) -> Column:
    content = F.coalesce(n["Content"], F.lit(""))

    def at(name):
        return n["type"] == ENGINE + name

    def script(action):
        return F.concat(F.lit(f"{action}: "), F.coalesce(n["Script"]["Script"], F.lit("")),
                        F.lit(" :: "), F.coalesce(n["Script"]["Function"], F.lit("")))

    def listed(title, rows):
        return F.array_join(F.concat(F.array(title), F.coalesce(
            rows, F.array().cast("array<string>"))), "\n")

    expressions = F.transform(n["Outputs"], lambda o: F.coalesce(o["Expression"], F.lit("")))
    step = F.regexp_extract(content, r"^(\S*) ([+-]?\d+)$", 2)
    signed = F.when(F.rlike(step, F.lit("^[+-]")), step).otherwise(F.concat(F.lit("+"), step))
    targets = F.transform(n["OtherDialogueInfos"], lambda i: F.when(
        (F.length(i["Tag"]) > 0) & (F.length(i["Dialogue"]) > 0),
        F.concat(i["Tag"], F.lit(" ("), i["Dialogue"], F.lit(")"))).otherwise(
        F.coalesce(F.nullif(i["Tag"], F.lit("")), i["Dialogue"], F.lit(""))))
    other = F.concat(F.lit("System action: "), F.coalesce(F.nullif(F.substring_index(
        n["type"], "/", -1), F.lit("")), F.lit("Unknown type")))
    return (
        F.when(at("CheckBooleanDialogueNode"), F.concat(F.lit("Check boolean: "), content))
        .when(at("CheckBooleanScriptDialogueNode"), script("Check script"))
        .when(at("ScriptDialogueNode"), script("Run script"))
        .when(at("CheckMultiBooleanDialogueNode"), listed(F.lit("Check booleans"), expressions))
        .when(at("CheckCounterDialogueNode"), listed(F.concat(
            F.lit("Check counter: "), F.coalesce(n["CounterName"], F.lit(""))), expressions))
        .when(at("SetBooleanDialogueNode"), F.when(content != "", F.concat(
            content, F.lit(" is now true"))).otherwise("Set boolean to true"))
        .when(at("ResetBooleanDialogueNode"), F.when(content != "", F.concat(
            content, F.lit(" is now false"))).otherwise("Reset boolean to false"))
        .when(at("IncCounterDialogueNode"), F.concat(F.lit("Increment counter: "), F.when(
            step != "", F.concat(F.substring_index(content, " ", 1), F.lit(" "), signed)
        ).otherwise(content)))
        .when(at("SpecialCompletionDialogueNode"), listed(F.concat(
            F.lit("Special completion"), F.coalesce(F.concat(
                F.lit(" (type "), n["CompletionType"], F.lit(")")), F.lit(""))), targets))
        .otherwise(F.concat_ws("\n", other, F.nullif(said, F.lit("")))))


def visible_text(n: Column, said: Column, kind: Column, name: str = "text") -> Column:
    """Text a reader sees for a node of each kind."""
    delta = n["ChemistryDelta"]
    signed = F.concat(F.when(delta >= 0, F.lit("+")).otherwise(F.lit("")), delta.cast("string"))
    content = F.coalesce(n["Content"], F.lit(""))
    return (
        F.when(kind == "start", content)
        .when(kind == "end", F.concat_ws("\n", F.lit("Chat finished"), F.when(
            content != "", F.concat(F.lit("Next conversation: "), content))))
        .when(kind == "chemistry", F.when(delta.isNotNull(), F.concat(
            signed, F.lit(" Chemistry"))).otherwise("Chemistry"))
        .when(kind == "system", _system_text(n, said)).otherwise(said)).alias(name)


def file_nodes(files: DataFrame, dictionary: DataFrame | None = None,
               sender: str = "") -> DataFrame:
    """Nodes of native files with their kind and visible text; nodes without id drop out."""
    n = F.col("n")
    rows = files.select("file", F.explode("nodes").alias("n")).filter("n.Id IS NOT NULL")
    key = F.coalesce(F.nullif(n["LocTag"], F.lit("")), n["Content"], F.lit(""))
    rows = rows.withColumn("text_key", key)
    if dictionary is not None:
        from foliant.operators.skew import lookup_join
        rows = lookup_join(rows, dictionary.select(F.col("key").alias("text_key"),
                                                   F.col("text").alias("said")),
                           ["text_key"], F.col("file"), "left")
        rows = rows.withColumn("said", F.coalesce("said", "text_key"))
    else:
        rows = rows.withColumn("said", F.col("text_key"))
    kind = node_kind(n["type"])
    return rows.select(
        "file", n["Id"].alias("node"), kind.alias("kind"),
        F.when(kind == "choice", "You").otherwise(F.coalesce(
            F.nullif(n["Speaker"], F.lit("")), F.when(kind == "npc", F.lit(sender)), F.lit("")))
        .alias("speaker"), visible_text(n, F.col("said"), kind))


def _routes(n: Column) -> Column:
    none = F.array().cast("array<int>")

    def entries(route, targets, label):
        return F.transform(F.coalesce(targets, none), lambda t, i: F.struct(
            route.alias("route"), i.alias("slot"), t.alias("target"), label.alias("label")))

    plain = [entries(F.lit(r), n[r], F.lit(label))
             for r, label in (("Outgoing", ""), ("TrueNodes", "True"), ("FalseNodes", "False"))]
    outputs = F.flatten(F.transform(
        F.coalesce(n["Outputs"], F.array().cast(
            "array<struct<Expression:string,Outgoing:array<int>>>")),
        lambda o, k: entries(F.concat(F.lit("Outputs:"), k.cast("string")), o["Outgoing"],
                             F.coalesce(o["Expression"], F.lit("")))))
    return F.concat(*plain, outputs)


def file_edges(files: DataFrame) -> DataFrame:
    """One edge per outgoing entry; parallel routes stay, targets without a node drop out.

    A file is one cell, so its ids are checked inside the row.
    """
    ids = F.filter(F.transform("nodes", lambda n: n["Id"]), lambda i: i.isNotNull())
    base = files.select("file", ids.alias("ids"), F.explode("nodes").alias("n")).filter(
        "n.Id IS NOT NULL")
    return base.select("file", "ids", F.col("n.Id").alias("source"), F.inline(
        _routes(F.col("n")))).filter(F.array_contains("ids", F.col("target"))).select(
        "file", "source", "route", "slot", "target", "label")


WALKED = (*NODE_KINDS.values(), "system")  # kinds by number
WALK = StructType([
    StructField("reached", ArrayType(IntegerType())),
    StructField("listed", ArrayType(IntegerType()))])


def _walk(start: int, links: dict[int, list[int]], kinds: dict[int, str]):
    """Depth-first walk: nodes reached, and the spoken ones in reading order.

    Reachability follows every edge; the reading order does not go past an end node.
    """
    def visit(stop_at_end):
        seen, order, todo = set(), [], [start]
        while todo:
            node = todo.pop()
            if node in seen:
                continue
            seen.add(node)
            order.append(node)
            if not (stop_at_end and kinds[node] == "end"):
                todo.extend(reversed(links.get(node, ())))
        return order

    reached = visit(False)
    return reached, [n for n in visit(True) if kinds[n] in ("npc", "choice")]


@F.pandas_udf(WALK)
def _walks(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]
           ) -> Iterator[pd.DataFrame]:
    # Graphs come and go as flat numbers: as a struct for each node and edge, a batch of them
    # would fill gigabytes.
    for columns in batches:
        reached, listed = [], []
        for start, ids, kinds, sources, targets in zip(*columns):
            links: dict[int, list[int]] = {}
            for source, target in zip(sources.tolist(), targets.tolist()):
                links.setdefault(source, []).append(target)
            walked = _walk(start, links, dict(zip(ids.tolist(), (WALKED[k] for k in kinds.tolist()))))
            for out, nodes in zip((reached, listed), walked):
                out.append(np.array(nodes, np.int32))
        yield pd.DataFrame({"reached": reached, "listed": listed})


def conversation_walks(files: DataFrame) -> DataFrame:
    """Per start node: the nodes of its conversation and the messages in reading order.

    The walk is order-dependent, but each graph is one small cell: many run in parallel
    and nothing is shuffled.
    """
    present = F.filter("nodes", lambda n: n["Id"].isNotNull())
    df = files.select("file", present.alias("nodes"))
    from foliant.functions.text import once
    df = once(df, "ids", F.transform("nodes", lambda n: n["Id"]))
    df = once(df, "kinds", F.transform("nodes", lambda n: F.array_position(
        F.lit(list(WALKED)), node_kind(n["type"])).cast("int") - 1))
    df = once(df, "links", F.flatten(F.transform("nodes", lambda n: F.transform(
        F.filter(_routes(n), lambda r: F.array_contains("ids", r["target"])),
        lambda r: F.struct(n["Id"].alias("source"), r["target"].alias("target"))))))
    begins = F.filter(F.arrays_zip("ids", "kinds"), lambda n: n["kinds"] == WALKED.index("start"))
    starts = df.select("file", "ids", "kinds", "links.source", "links.target",
                       F.explode(begins["ids"]).alias("start"))
    return starts.select("file", "start", _walks("start", "ids", "kinds", "source", "target").alias(
        "w")).select("file", "start", "w.reached", "w.listed")


def union_graphs(graphs: list[DataFrame], key: str) -> DataFrame:
    """Union of node (or edge) tables in which the first graph's row wins per id."""
    parts = [g.withColumn("graph_no", F.lit(i)) for i, g in enumerate(graphs)]
    united = parts[0]
    for p in parts[1:]:
        united = united.unionByName(p)
    return ordered.first_wins(united, [key], [F.col("graph_no").asc()])
