"""Graphs, and the file sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant import staging
from foliant.functions import html as H
from foliant.operators import export
from foliant.operators import graph as G
from foliant.plans import sql as S
from foliant.plans.clean import lit_sql
from foliant.plans.registry import query
from foliant.session import materialize
from foliant.sources import files as FS

_LINKS = f"""lk AS (SELECT page_id, trim(unnest(regexp_extract_all(html, {lit_sql(H.HREF)}, 1))) AS href FROM pages),
pt AS (SELECT DISTINCT page_id, coalesce(nullif(regexp_replace(regexp_replace(href, '[#?].*$', ''), '/+$', ''), ''), '/') AS path
  FROM lk WHERE starts_with(href, '/') AND NOT starts_with(href, '//')),
links AS (SELECT * FROM pt WHERE NOT regexp_matches(path, {lit_sql(H.ASSETS)}) AND NOT contains(lower(path), '/the'))"""


def page_links(spark, sf):
    pages = staging.table(spark, sf, "pages").select("page_id", H.host_of(F.col("url")).alias(
        "host"), F.explode(H.page_links(F.col("html"))).alias("href"), "html")
    return pages.select("page_id", H.link_path(
        F.col("href"), F.col("host"), "/", ("/the",)).alias("path")).filter(
        "path IS NOT NULL").distinct()


@query("extract_links", f"WITH {_LINKS} SELECT page_id, path FROM links")
def extract_links(spark, sf):
    return page_links(spark, sf)


_H1 = r"<h1>([^ <]+)"
_GRAPH = f"""{_LINKS.replace(" AND NOT contains(lower(path), '/the')", "")},
ed AS (SELECT DISTINCT '/' || regexp_extract(html, {lit_sql(_H1)}, 1) AS source, path AS target
  FROM pages JOIN links USING (page_id))"""


def link_edges(spark, sf):
    pages = staging.table(spark, sf, "pages")
    links = pages.select(
        F.concat(F.lit("/"), F.regexp_extract("html", _H1, 1)).alias("source"),
        H.host_of(F.col("url")).alias("host"), F.explode(H.page_links(F.col("html"))).alias("href"))
    return links.select("source", H.link_path(F.col("href"), F.col("host")).alias("target")).filter(
        "target IS NOT NULL").distinct()


@query("reachable_pages", f"""
WITH RECURSIVE {_GRAPH}, walk AS (SELECT '/The' AS node UNION SELECT target FROM walk JOIN ed ON ed.source = walk.node)
SELECT node FROM walk""")
def reachable_pages(spark, sf):
    """Paths reachable from the seed over the link graph."""
    seeds = staging.table(spark, sf, "pages").select(F.lit("/The").alias("node")).limit(1)
    return G.reachable(link_edges(spark, sf), seeds).select("node")


# Native dialogue files derived from the documents: one node per line.
_TYPES = ("StartDialogueNode", "DialogueNode", "PlayerChoiceDialogueNode", "ChemistryDialogueNode",
          "CheckBooleanDialogueNode", "CheckMultiBooleanDialogueNode", "DialogueNode",
          "EndDialogueNode")


def native_nodes(text):
    lines = F.split(text, "\n")
    kinds = F.array(*[F.lit(G.ENGINE + t) for t in _TYPES])

    def node(line, i):
        k = F.when(i == 0, 0).otherwise(i % 7 + 1)
        nxt = F.array(i + 1, i + 1 + (F.length(line) % 4).cast("int"))
        return F.struct(
            F.when(i % 29 != 28, i).alias("Id"), F.get(kinds, k).alias("type"),
            line.alias("Content"),
            F.when(k == 1, F.concat(F.lit("tag"), F.length(line).cast("string"))).alias("LocTag"),
            F.when(k == 6, "Narrator").alias("Speaker"),
            F.when(k == 3, (F.length(line) % 11).cast("int") - 5).alias("ChemistryDelta"),
            F.when(~k.isin(4, 5, 7), nxt).alias("Outgoing"),
            F.when(k == 4, F.array(i + 1)).alias("TrueNodes"),
            F.when(k == 4, F.array(i + 2, i - 3)).alias("FalseNodes"),
            F.when(k == 5, F.array(
                F.struct(F.lit("a > 1").alias("Expression"), F.array(i + 1).alias("Outgoing")),
                F.struct(F.lit("else").alias("Expression"), F.array(i + 3, i + 1).alias("Outgoing"))
            )).alias("Outputs"),
            F.lit(None).cast("struct<Script:string,Function:string>").alias("Script"),
            F.lit(None).cast("string").alias("CounterName"),
            F.lit(None).cast("string").alias("CompletionType"),
            F.lit(None).cast("array<struct<Tag:string,Dialogue:string>>")
            .alias("OtherDialogueInfos"))

    return F.transform(lines, node)


def native_files(spark, sf):
    return staging.table(spark, sf, "documents").select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("file"),
        native_nodes(F.col("text")).alias("nodes"))


_K = "CASE WHEN i = 0 THEN 0 ELSE i % 7 + 1 END"
NATIVE = f"""nl AS (SELECT 'doc' || doc_id AS file, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
nn AS (SELECT *, {_K} AS k FROM nl WHERE i % 29 <> 28),
ne AS (SELECT file, i AS source, 'Outgoing' AS route, 0 AS slot, i + 1 AS target, '' AS label FROM nn WHERE k NOT IN (4, 5, 7)
  UNION ALL SELECT file, i, 'Outgoing', 1, i + 1 + length(line) % 4, '' FROM nn WHERE k NOT IN (4, 5, 7)
  UNION ALL SELECT file, i, 'TrueNodes', 0, i + 1, 'True' FROM nn WHERE k = 4
  UNION ALL SELECT file, i, 'FalseNodes', 0, i + 2, 'False' FROM nn WHERE k = 4
  UNION ALL SELECT file, i, 'FalseNodes', 1, i - 3, 'False' FROM nn WHERE k = 4
  UNION ALL SELECT file, i, 'Outputs:0', 0, i + 1, 'a > 1' FROM nn WHERE k = 5
  UNION ALL SELECT file, i, 'Outputs:1', 0, i + 3, 'else' FROM nn WHERE k = 5
  UNION ALL SELECT file, i, 'Outputs:1', 1, i + 1, 'else' FROM nn WHERE k = 5),
nedge AS (SELECT e.* FROM ne e JOIN nn ON nn.file = e.file AND nn.i = e.target)"""


@query("native_edges", f"""
WITH {NATIVE} SELECT file, source::INTEGER AS source, route, slot::INTEGER AS slot, target::INTEGER AS target, label FROM nedge""")
def native_edges(spark, sf):
    return G.file_edges(native_files(spark, sf))


@query("native_nodes", f"""
WITH {NATIVE}, d AS (SELECT DISTINCT 'tag' || length(line) AS key, 'Text ' || length(line) AS text FROM nl WHERE length(line) % 2 = 0),
t AS (SELECT nn.*, line AS content, CASE k WHEN 1 THEN 'tag' || length(line) ELSE line END AS key FROM nn),
v AS (SELECT t.*, coalesce(d.text, t.key) AS said FROM t LEFT JOIN d ON t.key = d.key)
SELECT file, i::INTEGER AS node, CASE k WHEN 0 THEN 'start' WHEN 1 THEN 'npc' WHEN 2 THEN 'choice' WHEN 3 THEN 'chemistry'
    WHEN 6 THEN 'npc' WHEN 7 THEN 'end' ELSE 'system' END AS kind,
  CASE k WHEN 2 THEN 'You' WHEN 6 THEN 'Narrator' ELSE '' END AS speaker,
  CASE k WHEN 0 THEN content WHEN 7 THEN 'Chat finished' || CASE WHEN content <> '' THEN chr(10) || 'Next conversation: ' || content ELSE '' END
    WHEN 3 THEN CASE WHEN length(line) % 11 >= 5 THEN '+' ELSE '' END || (length(line) % 11 - 5) || ' Chemistry'
    WHEN 4 THEN 'Check boolean: ' || content WHEN 5 THEN 'Check booleans' || chr(10) || 'a > 1' || chr(10) || 'else'
    ELSE said END AS text FROM v""")
def native_nodes_query(spark, sf):
    lines = staging.table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    words = lines.filter(F.length("line") % 2 == 0).select(F.length("line").alias("n")).distinct(
    ).select(F.concat(F.lit("tag"), F.col("n").cast("string")).alias("key"),
             F.concat(F.lit("Text "), F.col("n").cast("string")).alias("text"))
    return G.file_nodes(native_files(spark, sf), words)


@query("conversation_graph", f"""
WITH RECURSIVE {NATIVE}, walk AS (SELECT file, 0::BIGINT AS node FROM nn WHERE i = 0
  UNION SELECT w.file, e.target FROM walk w JOIN nedge e ON e.file = w.file AND e.source = w.node)
SELECT file, 0 AS start, node::INTEGER AS node FROM walk""")
def conversation_graph(spark, sf):
    walks = G.conversation_walks(native_files(spark, sf))
    return walks.select("file", "start", F.explode("reached").alias("node"))


@query("dfs_messages")
def dfs_messages(spark, sf):
    walks = G.conversation_walks(native_files(spark, sf))
    return walks.select("file", "start", F.posexplode("listed").alias("position", "node"))


@query("graph_audit", f"""
WITH {NATIVE}
SELECT 'duplicate node ids' AS check_name, (SELECT count(*) FROM (SELECT file, i FROM nn GROUP BY 1, 2 HAVING count(*) > 1)) AS violations
UNION ALL SELECT 'dangling targets', (SELECT count(*) FROM ne) - (SELECT count(*) FROM nedge)
UNION ALL SELECT 'lost routes', 0
UNION ALL SELECT 'parallel routes', (SELECT count(*) FROM (SELECT 1 FROM nedge GROUP BY file, source, target HAVING count(*) > 1))""")
def graph_audit(spark, sf):
    """Derived edges against the raw routes: ids, dangling targets, lost and parallel routes."""
    files = native_files(spark, sf)
    nodes = files.select("file", F.explode("nodes").alias("n")).filter("n.Id IS NOT NULL").select(
        "file", F.col("n.Id").alias("node"), "n")
    raw = nodes.select("file", F.col("node").alias("source"), F.explode(F.concat(*[
        F.coalesce(F.col(f"n.{c}"), F.array().cast("array<int>"))
        for c in ("Outgoing", "TrueNodes", "FalseNodes")], F.coalesce(F.flatten(F.transform(
            "n.Outputs", lambda o: o["Outgoing"])), F.array().cast("array<int>")))).alias("target"))
    ids = nodes.select("file", F.col("node").alias("target"))
    resolved = raw.join(ids, ["file", "target"], "left_semi").select("file", "source", "target")
    derived = G.file_edges(files).select("file", "source", "target")
    from foliant.schemas import count_violations
    return count_violations({
        "duplicate node ids": nodes.groupBy("file", "node").count().filter("count > 1"),
        "dangling targets": raw.join(ids, ["file", "target"], "left_anti"),
        "lost routes": resolved.exceptAll(derived).unionAll(derived.exceptAll(resolved)),
        "parallel routes": derived.groupBy("file", "source", "target").count().filter("count > 1"),
    })


@query("graph_union", f"""
WITH {S.LINES}, a AS (SELECT page_id || ':' || message_order AS id, speaker AS label, 0 AS g FROM lines WHERE length(message_text) > 200),
b AS (SELECT page_id || ':' || message_order AS id, 'other' AS label, 1 AS g FROM lines WHERE player_choice)
SELECT id, arg_min(label, g) AS label FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id""")
def graph_union(spark, sf):
    lines = staging.dialogue_lines(spark, sf)
    key = F.concat_ws(":", F.col("page_id").cast("string"), F.col("message_order").cast("string"))
    a = lines.filter(F.length("message_text") > 200).select(key.alias("id"), F.col("speaker").alias("label"))
    b = lines.filter("player_choice").select(key.alias("id"), F.lit("other").alias("label"))
    return G.union_graphs([a, b], "id").select("id", "label")


# --- files ---

@query("megafile_scan", f"""
WITH {S.PAGES_MD} SELECT bucket_id AS bucket, page_id, page_title, canon_status, length(content_markdown) AS chars FROM pages_md""")
def megafile_scan(spark, sf):
    """Bucket documents written out and scanned back into pages."""
    pages = staging.pages_md(spark, sf).drop("lang")
    docs = export.megafile_documents(pages, export.megafile_parts(pages, 100), "2024-01-01T00:00:00Z")
    path = FS.scratch_dir(spark, "megafiles")
    FS.write_megafiles(docs, path)
    return FS.read_megafiles(spark, path).select(
        "bucket", F.col("_pageid").alias("page_id"), "page_title", "canon_status",
        F.length("content_markdown").cast("long").alias("chars"))


MANIFEST_KEYS = 200_000  # part keys that the manifests of one range share


@query("manifest_entities", """
SELECT '/Items/' || p_partkey AS entity_id, 'ExportParts' AS entity_type,
  CASE WHEN p_size % 2 = 0 THEN 'en' ELSE 'fr' END AS lang, p_name AS name, p_type AS description
FROM part WHERE p_size % 5 <> 0""")
def manifest_entities(spark, sf):
    """Localized manifests written out (some malformed) and scanned into entities.

    Each manifest holds the entries of one part size and range of keys: about 4,000 of them at the
    sizes given, half a megabyte, so that files stay few and documents small.
    """
    part = staging.table(spark, sf, "part")
    entry = F.struct(F.when(F.col("p_size") % 5 != 0, F.concat(
        F.lit("/Items/"), F.col("p_partkey").cast("string"))).alias("uniqueName"),
        F.col("p_name").alias("name"), F.col("p_type").alias("description"))
    per_file = part.withColumn("bin", F.floor(F.col("p_partkey") / MANIFEST_KEYS)).groupBy(
        "p_size", "bin").agg(F.to_json(F.collect_list(entry)).alias("entries"))
    wrapped = F.when(F.col("p_size") % 3 == 0, F.col("entries")).otherwise(
        F.concat(F.lit('{"ExportParts":'), "entries", F.lit("}")))
    docs = per_file.select(F.when(F.col("p_size") % 2 == 0, "en").otherwise("fr").alias("lang"),
                           wrapped.alias("value"))
    path = FS.scratch_dir(spark, "manifests")
    # One document per file, as landed: the reader takes whole files.
    docs.repartition(64, F.xxhash64("value")).write.option("maxRecordsPerFile", 1).partitionBy(
        "lang").text(path)
    return FS.read_manifests(spark, path, "ExportParts")


@query("manifest_index", """
SELECT 'ExportParts_' || p_partkey || '.json' AS name, 'd' || p_size AS digest, 'ExportParts' AS category
FROM part WHERE p_size > 10 AND p_size % 2 = 0""")
def manifest_index(spark, sf):
    part = staging.table(spark, sf, "part")
    name = F.concat(F.when(F.col("p_size") % 2 == 0, "ExportParts_").otherwise("Other_"),
                    F.col("p_partkey").cast("string"), F.lit(".json"))
    line = F.concat(name, F.when(F.col("p_size") > 10, F.concat(
        F.lit("!00_d"), F.col("p_size").cast("string"))).otherwise("!00_"))
    path = FS.scratch_dir(spark, "index")
    part.select(line.alias("value")).write.text(path)
    return FS.read_manifest_index(spark, path, ["ExportParts"])


@query("dialogue_files", f"""
WITH {NATIVE} SELECT file, count(*) AS nodes FROM nn GROUP BY file""")
def dialogue_files(spark, sf):
    """Native dialogue files written as JSON and read back with their schema."""
    path = FS.scratch_dir(spark, "dialogues")
    native_files(spark, sf).select(F.to_json(F.struct("file", "nodes")).alias("value")).write.text(path)
    return FS.read_dialogue_files(spark, path).select("file", F.size(F.filter(
        "nodes", lambda n: n["Id"].isNotNull())).cast("long").alias("nodes"))


@query("file_changes", """
SELECT DISTINCT source AS file, CASE source WHEN 'src1' THEN 'added' WHEN 'src2' THEN 'removed'
  WHEN 'src3' THEN 'changed' ELSE 'unchanged' END AS change FROM documents""")
def file_changes(spark, sf):
    """Bucket folders against the stored fingerprints of the last run.

    Between the two runs one bucket lands, one goes, and one is written again as it was.
    """
    pages = staging.pages_plain(spark, sf).select("bucket_id", "content_markdown")
    place = FS.scratch_dir(spark, "buckets")

    def land(rows):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "bucket_id").text(place)

    land(pages.filter("bucket_id <> 'src1'"))
    stored = materialize(FS.folder_fingerprints(spark, place, "bucket_id"))
    land(pages.filter("bucket_id IN ('src1', 'src3')"))
    FS.drop_folder(spark, f"{place}/bucket_id=src2")
    return FS.file_changes(stored, FS.folder_fingerprints(spark, place, "bucket_id"))


