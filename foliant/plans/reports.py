"""Corpus reports, listings, ledgers and hierarchy payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant import schemas, staging
from foliant.functions import text as T
from foliant.operators import corpus, hierarchy
from foliant.plans import sql as S
from foliant.plans.registry import query

NAMES = ("the", "ing", "der", "que", "ción", "zzzz")


@query("raw_pages", f"""
SELECT 'site' AS source_name, page_id AS pageid, url AS title, length(html) AS content_chars
FROM pages
UNION ALL
SELECT 'wiki', doc_id, {S.TITLE}, length(text) FROM documents""")
def raw_pages(spark, sf):
    site = staging.table(spark, sf, "pages").select(
        F.lit("site").alias("source_name"), F.col("page_id").alias("pageid"),
        F.col("url").alias("title"), F.length("html").cast("long").alias("content_chars"))
    wiki = staging.table(spark, sf, "documents").select(
        F.lit("wiki").alias("source_name"), F.col("doc_id").alias("pageid"),
        staging.page_title(F.col("text")).alias("title"),
        F.length("text").cast("long").alias("content_chars"))
    return site.unionByName(wiki)


@query("corpus_stats", f"""
WITH {S.PAGES_MD}
SELECT canon_status, bucket_id, grouping_id(canon_status, bucket_id)::BIGINT AS level,
       count(*) AS pages, max(page_id) AS last_page_id
FROM pages_md GROUP BY GROUPING SETS ((canon_status), (bucket_id), ())""")
def corpus_stats(spark, sf):
    return corpus.corpus_stats(staging.pages_md(spark, sf))


@query("bucket_overview", f"""
WITH {S.PAGES_MD}
SELECT coalesce(bucket_id, '(all)') AS bucket_id, count(*) AS pages,
       count(*) FILTER (canon_status = 'canon') AS canon,
       count(*) FILTER (canon_status = 'speculation') AS speculation,
       count(*) FILTER (canon_status = 'community_theory') AS theory
FROM pages_md GROUP BY ROLLUP (bucket_id)""")
def bucket_overview(spark, sf):
    return corpus.bucket_overview(staging.pages_md(spark, sf))


@query("entity_counts", """
SELECT count(*) AS entities, count(DISTINCT lang) AS n_langs,
       (SELECT string_agg(lang, ',' ORDER BY lang) FROM (SELECT DISTINCT lang FROM documents)) AS langs
FROM documents""")
def entity_counts(spark, sf):
    docs = staging.table(spark, sf, "documents")
    return docs.agg(
        F.count("*").alias("entities"), F.countDistinct("lang").alias("n_langs"),
        F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@query("feedback_tally", """
SELECT count(*) FILTER (event_type = 'click') AS up, count(*) FILTER (event_type = 'error') AS down
FROM events""")
def feedback_tally(spark, sf):
    ev = staging.table(spark, sf, "events")
    return ev.agg(F.count_if(F.col("event_type") == "click").alias("up"),
                  F.count_if(F.col("event_type") == "error").alias("down"))


@query("activity_ledger", f"""
WITH {S.EV} SELECT user_id, count(*) AS msg_count, min(us) AS first_seen, max(us) AS last_seen
FROM ev GROUP BY user_id""")
def activity_ledger(spark, sf):
    return staging.events(spark, sf).groupBy("user_id").agg(
        F.count("*").alias("msg_count"), F.min("us").alias("first_seen"),
        F.max("us").alias("last_seen"))


@query("turn_counters", """
SELECT coalesce(event_type, '(all)') AS kind, count(*) AS turns,
       count(*) FILTER (CAST(json_extract(props, '$.k') AS INTEGER) >= 50) AS rag_turns,
       count(*) FILTER (event_type = 'error') AS errors
FROM events GROUP BY ROLLUP (event_type)""")
def turn_counters(spark, sf):
    rag = F.get_json_object("props", "$.k").cast("int") >= 50
    return staging.table(spark, sf, "events").rollup("event_type").agg(
        F.count("*").alias("turns"), F.count_if(rag).alias("rag_turns"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
    ).select(F.coalesce("event_type", F.lit("(all)")).alias("kind"),
             "turns", "rag_turns", "errors")


@query("latency_percentiles", """
SELECT count(*) AS samples,
       round_even(quantile_disc(value, 0.5), 2)::DOUBLE AS p50,
       round_even(quantile_disc(value, 0.95), 2)::DOUBLE AS p95
FROM (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 200)""")
def latency_percentiles(spark, sf):
    return corpus.latency_percentiles(
        staging.events(spark, sf), "value", [F.col("us").desc(), F.col("event_id").desc()],
        (0.5, 0.95))


@query("merge_stats", """
SELECT count(*) AS pages, sum(length(text))::BIGINT AS chars,
  sum(CASE WHEN trim(text) = '' THEN 0 ELSE len(regexp_split_to_array(
      regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+')) END)::BIGINT AS words,
  (sum(length(text)) // 4)::BIGINT AS tokens,
  sum(len(regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+'))) > 400000
    AS large
FROM documents""")
def merge_stats(spark, sf):
    return corpus.merge_stats(staging.pages_plain(spark, sf), "content_markdown")


@query("chunk_audit", f"""
WITH c AS (
  SELECT doc_id AS page_id, n - 1 AS chunk_index, {S.TITLE} AS page_title, content FROM (
    SELECT doc_id, text, unnest(string_split(text, chr(10))) AS content,
           generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)),
t AS (SELECT count(*) AS total_chunks,
        count(*) FILTER (contains(lower(page_title), 'the')) AS title_matches FROM c)
SELECT page_id, chunk_index::INTEGER AS chunk_index,
  substr(trim(regexp_replace(content, '\\s+', ' ', 'g')), 1, 80) AS excerpt,
  total_chunks, title_matches
FROM (SELECT * FROM c ORDER BY page_id, chunk_index LIMIT 20), t""")
def chunk_audit(spark, sf):
    pages = staging.pages_plain(spark, sf)
    chunks = pages.select("page_id", "page_title", F.posexplode(
        T.lines(F.col("content_markdown"))).alias("chunk_index", "content"))
    return corpus.chunk_audit(chunks, "the", 20)


@query("recent_pages", """
SELECT o_orderkey AS page_id, o_orderstatus AS canon_status, epoch_us(o_orderdate) AS updated_us
FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25""")
def recent_pages(spark, sf):
    orders = staging.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("page_id"), F.col("o_orderstatus").alias("canon_status"),
        schemas.epoch_micros("o_orderdate").alias("updated_us"))
    return corpus.recent(orders, [F.col("updated_us").desc(), F.col("page_id").desc()], 25)


def _snippet_sql(content: str, needle: str, r: int) -> str:
    rules = [(r"\|[-|]+\|?\s*", " "), (r"\{[^}]+\}", " "), ("_[^_]+_?", " "),
             (r"\*\*([^*]+)\*\*", r"\1"), ("==[^=]+==", " "), ("~{2}[^~]+~{2}", " "),
             (r"\[[^\]]*\]", " "), ("[|]", " "), (r"\s+", " ")]
    at = f"(instr(lower({content}), '{needle}') - 1)"
    part = (f"CASE WHEN {at} < 0 THEN substr({content}, 1, {2 * r}) ELSE substr({content}, "
            f"greatest(0, {at} - {r}) + 1, {at} + {r} - greatest(0, {at} - {r})) END")
    body = f"regexp_replace({part}, '^\\s+|\\s+$', '', 'g')"
    for pattern, repl in rules:
        body = f"regexp_replace({body}, '{pattern}', '{repl}', 'g')"
    body = f"regexp_replace({body}, '^\\s+|\\s+$', '', 'g')"
    return (f"CASE WHEN {at} > {r} THEN '…' ELSE '' END || {body} || "
            f"CASE WHEN {at} >= 0 AND {at} < length({content}) - {r} THEN '…' ELSE '' END")


def _search_sql(needle: str, limit: int, radius: int, title_snippets: bool) -> str:
    snip = _snippet_sql("content_markdown", needle, radius)
    if not title_snippets:
        snip = f"CASE WHEN match_type = 'content' THEN {snip} ELSE '' END"
    return f"""
WITH {S.PAGES_MD}
SELECT page_id, bucket_id, page_title, canon_status, match_type, {snip} AS snippet FROM (
  SELECT *, CASE WHEN contains(lower(page_title), '{needle}') THEN 'title'
                 WHEN contains(lower(content_markdown), '{needle}') THEN 'content' END AS match_type
  FROM pages_md)
WHERE match_type IS NOT NULL
ORDER BY match_type DESC, bucket_id, lower(page_title), page_id LIMIT {limit}"""


@query("search_pages", _search_sql("thand", 50, 60, True))
def search_pages(spark, sf):
    return corpus.search(staging.pages_md(spark, sf), "Thand")


@query("suggest_pages", _search_sql("eitlich", 8, 44, False))
def suggest_pages(spark, sf):
    return corpus.search(staging.pages_md(spark, sf), "eitlich", 8, radius=44,
                         title_snippets=False)


@query("page_listing", f"""
WITH {S.PAGES_MD} SELECT bucket_id, lower(page_title) AS title_key, page_title, page_id, canon_status
FROM pages_md ORDER BY bucket_id, title_key, page_id""")
def page_listing(spark, sf):
    return staging.pages_md(spark, sf).select(
        "bucket_id", F.lower("page_title").alias("title_key"), "page_title", "page_id",
        "canon_status").orderBy("bucket_id", "title_key", "page_id")


@query("name_presence", f"""
WITH {S.PAGES_MD}, names AS (SELECT unnest({list(NAMES)}) AS name)
SELECT name, count(page_id) AS pages FROM names LEFT JOIN pages_md
  ON contains(lower(page_title), name) GROUP BY name""")
def name_presence(spark, sf):
    return corpus.name_presence(staging.pages_plain(spark, sf), NAMES)


_NODES = """nodes AS (
  SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent_id, r_name AS label FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer)"""


def hierarchy_nodes(spark, sf):
    region = staging.table(spark, sf, "region").select(
        F.concat(F.lit("r"), "r_regionkey").alias("id"),
        F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("label"))
    nation = staging.table(spark, sf, "nation").select(
        F.concat(F.lit("n"), "n_nationkey").alias("id"),
        F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("label"))
    customer = staging.table(spark, sf, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("id"),
        F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.col("c_name").alias("label"))
    return region.unionByName(nation).unionByName(customer)


@query("hierarchy_children", f"""
WITH {_NODES}
SELECT id, parent_id, label, EXISTS (SELECT 1 FROM nodes c WHERE c.parent_id = nodes.id)
  AS has_children FROM nodes""")
def hierarchy_children(spark, sf):
    return hierarchy.with_has_children(hierarchy_nodes(spark, sf))


@query("category_expand", f"""
WITH RECURSIVE {_NODES}, walk AS (
  SELECT id AS root, id, 0 AS depth FROM nodes WHERE parent_id IS NULL
  UNION ALL
  SELECT root, n.id, depth + 1 FROM walk JOIN nodes n ON n.parent_id = walk.id WHERE depth < 3)
SELECT root, id, min(depth) AS depth FROM walk GROUP BY root, id""")
def category_expand(spark, sf):
    nodes = hierarchy_nodes(spark, sf)
    return hierarchy.expand(nodes, nodes.filter("parent_id IS NULL"), 3)


@query("edge_partition", """
SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target, n_name AS label,
  CASE WHEN n_nationkey % 5 = n_regionkey THEN 'paradox' ELSE 'canonical' END AS edge_type
FROM nation""")
def edge_partition(spark, sf):
    paradox = F.col("n_nationkey") % 5 == F.col("n_regionkey")
    return staging.table(spark, sf, "nation").select(
        F.concat(F.lit("r"), "n_regionkey").alias("source"),
        F.concat(F.lit("n"), "n_nationkey").alias("target"), F.col("n_name").alias("label"),
        F.when(paradox, "paradox").otherwise("canonical").alias("edge_type"))


@query("graph_export", f"""
WITH {_NODES}
SELECT 'node' AS record, id AS key,
  '{{"id":"' || id || '","label":"' || label || '","has_children":' ||
  CASE WHEN EXISTS (SELECT 1 FROM nodes c WHERE c.parent_id = nodes.id) THEN 'true'
       ELSE 'false' END || '}}' AS payload FROM nodes
UNION ALL
SELECT 'edge', 'n' || n_nationkey, '{{"source":"r' || n_regionkey || '","target":"n' ||
  n_nationkey || '","type":"' ||
  CASE WHEN n_nationkey % 5 = n_regionkey THEN 'paradox' ELSE 'canonical' END || '"}}'
FROM nation""")
def graph_export(spark, sf):
    """One JSON record per node and edge: a flat export that writes in parallel."""
    nodes = hierarchy.with_has_children(hierarchy_nodes(spark, sf)).select(
        F.lit("node").alias("record"), F.col("id").alias("key"),
        F.to_json(F.struct("id", "label", "has_children")).alias("payload"))
    edges = edge_partition(spark, sf).select(
        F.lit("edge").alias("record"), F.col("target").alias("key"),
        F.to_json(F.struct("source", "target", F.col("edge_type").alias("type"))).alias("payload"))
    return nodes.unionByName(edges)


@query("constraint_checks", """
SELECT 'page id unique' AS check_name,
  (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)) AS violations
UNION ALL SELECT 'title unique', (SELECT count(*) FROM (
  SELECT """ + S.TITLE + """ AS t FROM documents GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'label has page', (SELECT count(*) FROM labels WHERE doc_id NOT IN
  (SELECT doc_id FROM documents))
UNION ALL SELECT 'page has label', (SELECT count(*) FROM documents WHERE doc_id NOT IN
  (SELECT doc_id FROM labels))
UNION ALL SELECT 'role known', (SELECT count(*) FROM conversations
  WHERE role NOT IN ('user', 'assistant'))""")
def constraint_checks(spark, sf):
    pages = staging.pages_plain(spark, sf)
    labels = staging.table(spark, sf, "labels")
    turns = staging.table(spark, sf, "conversations")
    return schemas.count_violations({
        "page id unique": schemas.duplicate_keys(pages, ["page_id"]),
        "title unique": schemas.duplicate_keys(pages, ["page_title"]),
        "label has page": schemas.orphans(labels, pages, "doc_id", "page_id"),
        "page has label": schemas.orphans(pages, labels, "page_id", "doc_id"),
        "role known": schemas.out_of_domain(turns, "role", ("user", "assistant")),
    })


@query("fk_orphans", """
SELECT l_orderkey, l_linenumber FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def fk_orphans(spark, sf):
    """Line rows whose order is not among the open or finished ones."""
    known = staging.table(spark, sf, "orders").filter("o_orderstatus <> 'P'")
    rows = staging.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return schemas.orphans(rows, known, "l_orderkey", "o_orderkey").select(
        "l_orderkey", "l_linenumber")
