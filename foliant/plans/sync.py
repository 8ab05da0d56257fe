"""Sync planning, reconciliation and upsert snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant import schemas, staging
from foliant.functions import text as T
from foliant.operators import dialogue, members, ordered, sync
from foliant.plans import sql as S
from foliant.plans.registry import query

SPECS = (
    {"id": "tales", "categories": tuple(f"src{i}" for i in range(0, 8)),
     "include": ("the", "die", "les"), "exclude": ("tion", "%%%")},
    {"id": "places", "categories": tuple(f"src{i}" for i in range(4, 14)), "include": ("er", "ou")},
    {"id": "rest", "categories": tuple(f"src{i}" for i in range(0, 18)), "exclude": ("zz",)},
)


def _assign_sql() -> str:
    def has(words):
        return "(" + " OR ".join(f"contains(lower(page_title), '{w}')" for w in words) + ")"

    arms = []
    for s in SPECS:
        cond = [f"bucket_id IN {s['categories']}"]
        if s.get("include"):
            cond.append(has(s["include"]))
        if s.get("exclude"):
            cond.append("NOT " + has(s["exclude"]))
        arms.append(f"WHEN {' AND '.join(cond)} THEN '{s['id']}'")
    return f"CASE {' '.join(arms)} END"


@query("bucket_assign", f"""
WITH {S.PAGES_MD}, a AS (SELECT page_id, page_title, {_assign_sql()} AS bucket FROM pages_md)
SELECT * FROM a WHERE bucket IS NOT NULL""")
def bucket_assign(spark, sf):
    pages = staging.pages_plain(spark, sf)
    return pages.select("page_id", "page_title", sync.assign_bucket(
        F.col("page_title"), F.col("bucket_id"), SPECS).alias("bucket")
    ).filter("bucket IS NOT NULL")


_PATH = "regexp_extract(url, '^https?://[^/]+([^?#]*)', 1)"


def site_paths(spark, sf):
    return staging.table(spark, sf, "pages").select(
        "page_id", "url", F.regexp_extract("url", r"^https?://[^/]+([^?#]*)", 1).alias("path"))


@query("prefix_discovery", f"""
SELECT page_id, path FROM (SELECT page_id, {_PATH} AS path FROM pages)
WHERE starts_with(path, '/en/') AND path <> '/en/' AND NOT ends_with(path, '/')
  AND NOT contains(path, '/File:')""")
def prefix_discovery(spark, sf):
    return sync.prefix_members(site_paths(spark, sf), "/en/").select("page_id", "path")


@query("title_union", f"""
WITH {S.PAGES_MD}
SELECT page_title AS title FROM pages_md WHERE bucket_id IN ('src1', 'src2', 'src3')
UNION SELECT {_PATH} FROM pages WHERE starts_with({_PATH}, '/fr/')""")
def title_union(spark, sf):
    by_category = staging.pages_plain(spark, sf).filter(
        F.col("bucket_id").isin("src1", "src2", "src3")).select(F.col("page_title").alias("title"))
    by_prefix = site_paths(spark, sf).filter("startswith(path, '/fr/')").select(
        F.col("path").alias("title"))
    return by_category.union(by_prefix).distinct()


@query("short_pages", """
SELECT doc_id AS page_id, length(trim(text)) AS chars FROM documents WHERE length(trim(text)) >= 20""")
def short_pages(spark, sf):
    size = F.length(F.trim("content_markdown")).cast("long")
    return staging.pages_plain(spark, sf).filter(size >= 20).select("page_id", size.alias("chars"))


@query("corpus_selection", f"""
WITH {S.PAGES_MD}, k AS (SELECT *, row_number() OVER (PARTITION BY bucket_id ORDER BY page_id) AS rn
  FROM pages_md WHERE lang = 'en' AND canon_status = 'canon' AND bucket_id NOT IN ('src0', 'src9'))
SELECT bucket_id, page_id, page_title FROM k WHERE rn <= 15""")
def corpus_selection(spark, sf):
    """Canon English pages of the chosen buckets, at most 15 per bucket."""
    pages = staging.pages_md(spark, sf).filter(
        "lang = 'en' AND canon_status = 'canon' AND bucket_id NOT IN ('src0', 'src9')")
    return ordered.recent_n(pages, ["bucket_id"], [F.col("page_id").asc()], 15).select(
        "bucket_id", "page_id", "page_title")


# Two snapshots of one table: what is stored, and what the source shows now.
_STORED = """stored AS (SELECT o_orderstatus AS bucket_id, o_orderkey AS page_id,
  o_orderpriority AS touched FROM orders WHERE o_totalprice < 400000)"""
_LIVE = """live AS (SELECT o_orderstatus AS bucket_id, o_orderkey AS page_id,
  CASE WHEN o_totalprice > 300000 THEN 'rev2' WHEN o_orderpriority = '5-LOW' THEN NULL
       ELSE o_orderpriority END AS touched, o_custkey < 50 AS missing
  FROM orders WHERE o_totalprice > 50000)"""


def stored_state(spark, sf):
    return staging.table(spark, sf, "orders").filter("o_totalprice < 400000").select(
        F.col("o_orderstatus").alias("bucket_id"), F.col("o_orderkey").alias("page_id"),
        F.col("o_orderpriority").alias("touched"))


def live_state(spark, sf):
    touched = F.when(F.col("o_totalprice") > 300000, "rev2").when(
        F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    return staging.table(spark, sf, "orders").filter("o_totalprice > 50000").select(
        F.col("o_orderstatus").alias("bucket_id"), F.col("o_orderkey").alias("page_id"),
        touched.alias("touched"), (F.col("o_custkey") < 50).alias("missing"))


_KEYS = ["bucket_id", "page_id"]


@query("delta_plan", f"""
WITH {_STORED}, {_LIVE}
SELECT l.bucket_id, l.page_id, l.touched, CASE WHEN l.touched IS NULL THEN 'no_signal'
  WHEN s.page_id IS NULL THEN 'new' ELSE 'changed' END AS reason
FROM live l LEFT JOIN stored s ON l.bucket_id = s.bucket_id AND l.page_id = s.page_id
WHERE NOT l.missing AND (l.touched IS NULL OR s.page_id IS NULL OR l.touched IS DISTINCT FROM s.touched)
""")
def delta_plan(spark, sf):
    return sync.delta_plan(live_state(spark, sf), stored_state(spark, sf), _KEYS)


@query("vanished", f"""
WITH {_STORED}, {_LIVE}
SELECT * FROM stored s WHERE NOT EXISTS (SELECT 1 FROM live l
  WHERE l.bucket_id = s.bucket_id AND l.page_id = s.page_id AND NOT l.missing)""")
def vanished(spark, sf):
    return sync.vanished(stored_state(spark, sf), live_state(spark, sf).filter("NOT missing"), _KEYS
                         ).select("bucket_id", "page_id", "touched")


@query("sync_ack", f"""
WITH {_STORED}, {_LIVE}
SELECT coalesce(l.bucket_id, s.bucket_id) AS bucket_id, coalesce(l.page_id, s.page_id) AS page_id,
  CASE WHEN l.page_id IS NOT NULL THEN l.touched ELSE s.touched END AS touched
FROM stored s FULL JOIN (SELECT * FROM live WHERE NOT missing AND touched IS NOT NULL) l
  ON l.bucket_id = s.bucket_id AND l.page_id = s.page_id""")
def sync_ack(spark, sf):
    fetched = live_state(spark, sf).filter("NOT missing AND touched IS NOT NULL").drop("missing")
    return sync.upsert(stored_state(spark, sf), fetched, _KEYS)


_OLD = """old AS (SELECT doc_id AS page_id, n - 1 AS chunk_index, c AS content FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS c,
    generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) WHERE length(c) > 60)"""
_NEW = """new AS (SELECT doc_id AS page_id, n - 1 AS chunk_index,
    CASE WHEN length(c) % 5 = 0 THEN '* ' || c ELSE c END AS content FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS c,
    generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) WHERE length(c) < 400)"""


def old_new_chunks(spark, sf):
    chunks = staging.pages_plain(spark, sf).select("page_id", F.posexplode(
        T.lines(F.col("content_markdown"))).alias("chunk_index", "content"))
    old = chunks.filter(F.length("content") > 60)
    edited = F.when(F.length("content") % 5 == 0, F.concat(F.lit("* "), "content")).otherwise(F.col("content"))
    new = chunks.filter(F.length("content") < 400).withColumn("content", edited)
    return old, new


@query("chunk_reconcile", f"""
WITH {_OLD}, {_NEW}
SELECT coalesce(o.page_id, n.page_id) AS page_id,
  coalesce(o.chunk_index, n.chunk_index)::INTEGER AS chunk_index,
  CASE WHEN o.page_id IS NULL THEN 'insert' WHEN n.page_id IS NULL THEN 'delete'
       WHEN o.content IS NOT DISTINCT FROM n.content THEN 'keep' ELSE 'update' END AS action,
  coalesce(n.content, o.content) AS content
FROM old o FULL JOIN new n ON o.page_id = n.page_id AND o.chunk_index = n.chunk_index""")
def chunk_reconcile(spark, sf):
    return sync.reconcile(*old_new_chunks(spark, sf), ["page_id", "chunk_index"], ["content"])


@query("stale_indices", f"""
WITH {_OLD}, {_NEW}
SELECT page_id, chunk_index::INTEGER AS chunk_index FROM old
EXCEPT SELECT page_id, chunk_index::INTEGER FROM new""")
def stale_indices(spark, sf):
    old, new = old_new_chunks(spark, sf)
    keys = ["page_id", "chunk_index"]
    return old.select(*keys).exceptAll(new.select(*keys))


_SPLIT = f"""{S.PAGES_MD}, stored AS (SELECT page_id, page_title, bucket_id, canon_status FROM pages_md
  WHERE bucket_id <> 'src3'),
incoming AS (SELECT page_id, page_title, 'new_' || bucket_id AS bucket_id, canon_status FROM pages_md
  WHERE lang IN ('en', 'es'))"""


def page_snapshots(spark, sf):
    pages = staging.pages_md(spark, sf).select(
        "page_id", "page_title", "bucket_id", "canon_status", "lang")
    stored = pages.filter("bucket_id <> 'src3'").drop("lang")
    incoming = pages.filter("lang IN ('en', 'es')").drop("lang").withColumn(
        "bucket_id", F.concat(F.lit("new_"), "bucket_id"))
    return stored, incoming


@query("recreated_pages", f"""
WITH {_SPLIT}
SELECT DISTINCT s.page_id, s.page_title, s.bucket_id FROM stored s JOIN incoming i
  ON s.page_title = i.page_title AND s.page_id <> i.page_id""")
def recreated_pages(spark, sf):
    stored, incoming = page_snapshots(spark, sf)
    return sync.recreated(stored, incoming, "page_title", "page_id").select(
        "page_id", "page_title", "bucket_id")


@query("cascade_delete", f"""
WITH {_SPLIT}, gone AS (SELECT s.page_id FROM stored s JOIN incoming i
  ON s.page_title = i.page_title AND s.page_id <> i.page_id),
{_OLD} SELECT page_id, chunk_index::INTEGER AS chunk_index FROM old
WHERE page_id NOT IN (SELECT page_id FROM gone)""")
def cascade_delete(spark, sf):
    """Chunks left after the recreated pages went with all their children."""
    stored, incoming = page_snapshots(spark, sf)
    gone = sync.recreated(stored, incoming, "page_title", "page_id")
    old, _ = old_new_chunks(spark, sf)
    return sync.cascade({"chunks": old}, gone, "page_id")["chunks"].select(
        "page_id", "chunk_index")


@query("page_upsert", f"""
WITH {_SPLIT}
SELECT coalesce(i.page_id, s.page_id) AS page_id, coalesce(i.page_title, s.page_title) AS page_title,
  coalesce(i.bucket_id, s.bucket_id) AS bucket_id,
  coalesce(i.canon_status, s.canon_status) AS canon_status,
  coalesce(s.page_id, 1000000000) AS created_at,
  CASE WHEN i.page_id IS NOT NULL THEN 2000000000 ELSE s.page_id END AS updated_at
FROM stored s FULL JOIN incoming i ON s.page_id = i.page_id""")
def page_upsert(spark, sf):
    stored, incoming = page_snapshots(spark, sf)
    stored = stored.withColumn("created_at", F.col("page_id")).withColumn(
        "updated_at", F.col("page_id"))
    first_seen = F.lit(1_000_000_000).cast("long")
    incoming = incoming.withColumn("created_at", first_seen).withColumn("updated_at", first_seen)
    return sync.upsert(stored, incoming, ["page_id"], keep_stored=["created_at"],
                       stamp="updated_at", now=F.lit(2_000_000_000).cast("long"))


@query("entity_upsert", """
WITH stored AS (SELECT 'P' || p_partkey AS entity_id, 'en' AS lang, p_name AS name, p_type AS kind
  FROM part WHERE p_size < 40),
incoming AS (SELECT 'P' || p_partkey AS entity_id, 'en' AS lang, upper(p_name) AS name, p_brand AS kind
  FROM part WHERE p_size > 20)
SELECT * FROM incoming UNION ALL SELECT * FROM stored WHERE entity_id NOT IN
  (SELECT entity_id FROM incoming)""")
def entity_upsert(spark, sf):
    part = staging.table(spark, sf, "part")
    base = part.withColumn("entity_id", F.concat(F.lit("P"), "p_partkey")).withColumn(
        "lang", F.lit("en"))
    stored = base.filter("p_size < 40").select(
        "entity_id", "lang", F.col("p_name").alias("name"), F.col("p_type").alias("kind"))
    incoming = base.filter("p_size > 20").select(
        "entity_id", "lang", F.upper("p_name").alias("name"), F.col("p_brand").alias("kind"))
    return sync.last_wins([stored, incoming], ["entity_id", "lang"])


@query("page_replace", f"""
WITH {S.LINES}, fresh AS (SELECT page_id, message_order, upper(speaker) AS speaker FROM lines
  WHERE player_choice AND length(message_text) > 600)
SELECT * FROM fresh UNION ALL
SELECT page_id, message_order, speaker FROM lines WHERE page_id NOT IN (SELECT page_id FROM fresh)""")
def page_replace(spark, sf):
    lines = staging.dialogue_lines(spark, sf)
    fresh = lines.filter(F.col("player_choice") & (F.length("message_text") > 600)).select(
        "page_id", "message_order", F.upper("speaker").alias("speaker"))
    return sync.replace_pages(lines.select("page_id", "message_order", "speaker"), fresh, "page_id")


@query("dialogue_merge", f"""
WITH {S.LINES}, s AS (SELECT page_id, message_order, speaker, '* ' || message_text AS message_text
  FROM lines WHERE speaker = 'assistant'),
t AS (SELECT page_id, message_order, 'x' AS speaker, message_text FROM lines
  WHERE length(message_text) > 300)
SELECT coalesce(s.page_id, t.page_id) AS page_id, coalesce(s.message_order, t.message_order)
  AS message_order, coalesce(s.speaker, t.speaker) AS speaker,
  coalesce(s.message_text, t.message_text) AS message_text,
  CASE WHEN s.page_id IS NULL THEN 'kept' WHEN t.page_id IS NULL THEN 'inserted' ELSE 'updated' END
    AS action
FROM s FULL JOIN t ON s.page_id = t.page_id AND s.message_order = t.message_order""")
def dialogue_merge(spark, sf):
    lines = staging.dialogue_lines(spark, sf)
    source = lines.filter("speaker = 'assistant'").withColumn(
        "message_text", F.concat(F.lit("* "), "message_text"))
    target = lines.filter(F.length("message_text") > 300).withColumn("speaker", F.lit("x"))
    return dialogue.merge_tables(source, target, ["page_id", "message_order"],
                                 ["speaker", "message_text"])


@query("megafile_merge", f"""
WITH {_SPLIT}, gone AS (SELECT page_title FROM pages_md WHERE canon_status = 'speculation'),
kept AS (SELECT page_title, max(bucket_id) AS bucket_id FROM stored
  WHERE page_title NOT IN (SELECT page_title FROM gone) GROUP BY 1),
inc AS (SELECT page_title, max(bucket_id) AS bucket_id FROM incoming GROUP BY 1)
SELECT page_title, bucket_id FROM inc UNION ALL
SELECT page_title, bucket_id FROM kept WHERE page_title NOT IN (SELECT page_title FROM inc)""")
def megafile_merge(spark, sf):
    stored, incoming = page_snapshots(spark, sf)
    gone = staging.pages_md(spark, sf).filter("canon_status = 'speculation'").select("page_title")
    one = [F.max("bucket_id").alias("bucket_id")]
    return sync.merge_megafile(stored.groupBy("page_title").agg(*one), gone,
                               incoming.groupBy("page_title").agg(*one), ["page_title"])


@query("priority_merge", """
WITH curated AS (SELECT lower(n_name) AS key, 'curated' AS era FROM nation WHERE n_regionkey < 2),
directory AS (SELECT lower(n_name) AS key, 'directory' AS era FROM nation WHERE n_nationkey <> 7),
quests AS (SELECT DISTINCT lower(p_name) AS key, 'quest ' || min(p_type) AS era FROM part GROUP BY 1),
u AS (SELECT *, 1 AS p FROM curated UNION ALL SELECT *, 2 FROM directory UNION ALL
      SELECT *, 3 FROM quests)
SELECT key, arg_min(era, p) AS era FROM u GROUP BY key""")
def priority_merge(spark, sf):
    nation = staging.table(spark, sf, "nation").withColumn("key", F.lower("n_name"))
    curated = nation.filter("n_regionkey < 2").select("key", F.lit("curated").alias("era"))
    directory = nation.filter("n_nationkey <> 7").select("key", F.lit("directory").alias("era"))
    quests = staging.table(spark, sf, "part").groupBy(F.lower("p_name").alias("key")).agg(
        F.concat(F.lit("quest "), F.min("p_type")).alias("era"))
    return sync.first_priority([curated, directory, quests], ["key"])


@query("directory_intersect", f"""
WITH {S.PAGES_MD}, w AS (SELECT DISTINCT lower(x) AS name FROM (
  SELECT unnest(string_split(p_name, ' ')) AS x FROM part)),
s AS (SELECT DISTINCT lower(page_title) AS t, unnest(string_split(lower(page_title), ' ')) AS name
  FROM pages_md)
SELECT DISTINCT name FROM s INTERSECT SELECT name FROM (
  SELECT name FROM w UNION ALL SELECT lower(split_part(text, ' ', 1)) FROM benchmark)""")
def directory_intersect(spark, sf):
    """Words of the page titles that the entity directory also knows."""
    words = staging.pages_plain(spark, sf).select(
        F.explode(F.split(F.lower("page_title"), " ")).alias("name"))
    parts = staging.table(spark, sf, "part").select(
        F.explode(F.split(F.lower("p_name"), " ")).alias("name"))
    heads = staging.table(spark, sf, "benchmark").select(
        F.lower(F.split_part("text", F.lit(" "), F.lit(1))).alias("name"))
    return words.intersect(parts.unionByName(heads))


@query("feedback_upsert", """
SELECT user_id, key, arg_max(verdict, (us, event_id)) AS verdict FROM (
  SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS key, epoch_us(ts) AS us, event_id,
    CASE event_type WHEN 'click' THEN 'up' WHEN 'error' THEN 'down' ELSE event_type END AS verdict
  FROM events) WHERE verdict IN ('up', 'down') GROUP BY ALL""")
def feedback_upsert(spark, sf):
    verdict = F.when(F.col("event_type") == "click", "up").when(
        F.col("event_type") == "error", "down").otherwise(F.col("event_type"))
    feedback = staging.events(spark, sf).select(
        "user_id", F.get_json_object("props", "$.k").cast("long").alias("key"), "us", "event_id",
        verdict.alias("verdict"))
    return members.last_verdict(feedback, ["user_id", "key"])


@query("member_purge", """
SELECT event_id, user_id FROM events WHERE user_id NOT IN
  (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 95)""")
def member_purge(spark, sf):
    ev = staging.table(spark, sf, "events")
    departed = ev.filter("event_type = 'signup' AND value > 95").select("user_id")
    return ev.select("event_id", "user_id").join(departed.distinct(), "user_id", "left_anti").select(
        "event_id", "user_id")


@query("canon_status", f"""
WITH {S.WIKI}, l AS (SELECT doc_id FROM labels WHERE quality = 0)
SELECT page_id, CASE WHEN l.doc_id IS NOT NULL OR
  regexp_matches(wikitext, '(?i)\\{{\\{{\\s*(speculation|conjecture|theory)\\s*[|}}]')
  THEN 'speculation' ELSE 'canon' END AS canon_status
FROM wiki LEFT JOIN l ON page_id = l.doc_id""")
def canon_status(spark, sf):
    """Page-level category and inline signals, the most cautious one kept."""
    from foliant.functions.wikitext import has_non_canon
    listed = staging.table(spark, sf, "labels").filter("quality = 0").select(
        F.col("doc_id").alias("page_id"), F.lit(True).alias("listed"))
    pages = staging.wiki_pages(spark, sf).select(
        "page_id", has_non_canon(F.col("wikitext")).alias("inline"))
    j = pages.join(listed, "page_id", "left")

    def status(flag):
        return F.when(flag, "speculation").otherwise("canon")

    return j.select("page_id", sync.most_cautious(
        status(F.coalesce("listed", F.lit(False))), status(F.col("inline"))).alias("canon_status"))


@query("fk_guard", f"""
WITH {S.LINES}
SELECT page_id, message_order, page_id IN (SELECT doc_id FROM documents WHERE lang = 'en') AS known
FROM lines""")
def fk_guard(spark, sf):
    """Derived rows split into those with a known page and the rejects."""
    lines = staging.dialogue_lines(spark, sf).select("page_id", "message_order")
    known = staging.table(spark, sf, "documents").filter("lang = 'en'").select(
        F.col("doc_id").alias("page_id"))
    kept = lines.join(known, "page_id", "left_semi").withColumn("known", F.lit(True))
    rejects = schemas.orphans(lines, known, "page_id", "page_id").withColumn(
        "known", F.lit(False))
    return kept.unionByName(rejects)
