"""Structured-extraction job: rows derived from page text, and their rendering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant import staging
from foliant.functions import messages as M
from foliant.functions import text as T
from foliant.operators import extract as E
from foliant.operators import ordered
from foliant.plans import sql as S
from foliant.plans.clean import chain_sql, chat_pages, lit_sql, strip_sql
from foliant.plans.registry import query

_EX = "regexp_extract"


def _parsed_sql(source: str) -> str:
    x = "x"
    label = f"{_EX}(x, {lit_sql(E.BOLD_LINE)}, 1)"
    name = strip_sql(f"{_EX}({label}, '^(.*):[^:]*$', 1)")
    return f"""l0 AS (SELECT page_id, n, {strip_sql('line')} AS x FROM (
    SELECT page_id, unnest(string_split(content_markdown, chr(10))) AS line,
      generate_subscripts(string_split(content_markdown, chr(10)), 1) AS n FROM {source})),
l1 AS (SELECT page_id, n, x, CASE WHEN regexp_matches(x, {lit_sql(E.BOLD_LINE)}) THEN 'bold'
    WHEN regexp_matches(x, {lit_sql(E.CHOICE_LINE)}) THEN 'choice'
    WHEN regexp_matches(x, {lit_sql(E.PLAIN_LINE)}) THEN 'plain' END AS form FROM l0 WHERE x <> ''),
l2 AS (SELECT *, CASE form WHEN 'bold' THEN {name} WHEN 'choice' THEN ''
      WHEN 'plain' THEN {strip_sql(f"{_EX}({x}, {lit_sql(E.PLAIN_LINE)}, 1)")} END AS speaker,
    CASE form WHEN 'bold' THEN {strip_sql(f"{_EX}({x}, {lit_sql(E.BOLD_LINE)}, 2)")}
      WHEN 'choice' THEN {strip_sql(f"{_EX}({x}, {lit_sql(E.CHOICE_LINE)}, 1)")}
      WHEN 'plain' THEN {strip_sql(f"{_EX}({x}, {lit_sql(E.PLAIN_LINE)}, 2)")} END AS txt FROM l1)"""


def _accept_sql(speaker: str, txt: str) -> str:
    junk = (f"(regexp_matches({txt}, {lit_sql(M.NUMERIC_ONLY)}) OR "
            f"regexp_matches({txt}, {lit_sql(M.JUNK_LABEL)}))")
    return f"""coalesce({txt} <> '' AND NOT {junk} AND (form = 'choice' OR ({speaker} <> ''
  AND length({speaker}) <= 40 AND NOT regexp_matches({speaker}, '[*_\\]}}:]')
  AND regexp_matches({speaker}, '^\\p{{Lu}}')
  AND NOT regexp_matches({speaker}, {lit_sql(M.JUNK_IN_SPEAKER)}))), false)"""


@query("dialogue_rows", f"""
WITH {S.CHAT}, {_parsed_sql('chat')}
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY n) - 1)::INTEGER AS message_order,
  speaker, txt AS message_text, form = 'choice' AS player_choice
FROM l2 WHERE {_accept_sql('speaker', 'txt')}""")
def dialogue_rows(spark, sf):
    return E.dialogue_rows(chat_pages(spark, sf))


_END = lit_sql(E.END_MARKER)


@query("chaptered_rows", f"""
WITH {S.CHAT}, {_parsed_sql('chat')},
l3 AS (SELECT page_id, n, x, form, speaker,
  CASE WHEN regexp_matches(x, {lit_sql(E.CHAPTER_LINE)}) THEN {strip_sql(f"{_EX}(x, {lit_sql(E.CHAPTER_LINE)}, 1)")} END AS heading,
  coalesce(regexp_matches(txt, {_END}), false) AS own, regexp_matches(x, {_END}) AS marked,
  CASE WHEN regexp_matches(txt, {_END}) THEN {strip_sql(chain_sql('txt', ((E.END_MARKER, ''),)))} ELSE txt END AS txt
  FROM l2),
l4 AS (SELECT *, heading IS NULL AND {_accept_sql('speaker', 'txt')} AS msg,
  last_value(heading IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS chapter FROM l3),
l5 AS (SELECT *, sum(msg::INTEGER) OVER (PARTITION BY page_id ORDER BY n) AS no FROM l4 WHERE chapter IS NOT NULL),
l6 AS (SELECT *, bool_or(CASE WHEN msg THEN own ELSE form IS NULL AND heading IS NULL AND marked END)
  OVER (PARTITION BY page_id, no) AS gain FROM l5)
SELECT page_id, (no - 1)::BIGINT AS message_order, speaker, txt AS message_text,
  form = 'choice' AS player_choice, gain AS chemistry_gain, chapter FROM l6 WHERE msg""")
def chaptered_rows(spark, sf):
    return E.chaptered_rows(chat_pages(spark, sf), skip_intro=True)


_P = "regexp_extract(url, '^https?://[^/]+([^?#]*)', 1)"


@query("context_labels", f"""
SELECT page_id, CASE WHEN starts_with(p, '/fr/') THEN 'chat' WHEN ends_with(p, '/Transcript') THEN 'cinematic'
  ELSE 'quote' END AS kind,
  CASE WHEN starts_with(p, '/fr/') THEN 'Chat · ' || list_last(string_split(p, '/'))
       ELSE regexp_replace(p, '/(Quotes|Transcript)$', '') END AS context
FROM (SELECT page_id, {_P} || CASE WHEN page_id % 3 = 0 THEN '/Quotes' WHEN page_id % 3 = 1
  THEN '/Transcript' ELSE '' END AS p FROM pages)""")
def context_labels(spark, sf):
    path = F.concat(F.regexp_extract("url", r"^https?://[^/]+([^?#]*)", 1), F.when(
        F.col("page_id") % 3 == 0, "/Quotes").when(F.col("page_id") % 3 == 1, "/Transcript").otherwise(""))
    return staging.table(spark, sf, "pages").select(
        "page_id", E.context_label(path, "/fr/", "Chat · ").alias("c")).select(
        "page_id", "c.kind", "c.context")


def record_pages(spark, sf):
    """Collectible pages in record syntax, one per part."""
    part = staging.table(spark, sf, "part")
    nl = F.lit("\n")
    text = F.concat(
        F.col("p_type"), F.lit("| intro"), nl, F.lit("Found during the "), F.replace("p_brand", F.lit("#"), F.lit(" ")),
        F.lit(" Quest by all."), nl, F.lit("fragment = "), "p_name", nl,
        F.lit("|planet = P"), F.col("p_size").cast("string"), nl, F.lit("|loretext = "), "p_name",
        nl, F.lit("second line"), nl, nl, F.lit("|audio = "), nl, F.lit("ignored line"), nl,
        F.lit("fragment = B "), "p_name", nl, F.lit("|narrator = "), "p_brand", nl,
        F.lit("|hiddentext ="), nl, F.lit("h1"), nl, F.lit("h2"))
    return part.select(F.col("p_partkey").alias("page_id"), text.alias("content_markdown"))


@query("record_rows", """
SELECT p_partkey AS page_id, p_type AS series, replace(p_brand, '#', ' ') AS quest, 0 AS record_no, p_name AS item_name,
  'P' || p_size AS planet, NULL::VARCHAR AS narrator, p_name || chr(10) || 'second line' AS item_text,
  NULL::VARCHAR AS secret_text, NULL::VARCHAR AS audio FROM part
UNION ALL SELECT p_partkey, p_type, replace(p_brand, '#', ' '), 1, 'B ' || p_name, NULL, p_brand, NULL,
  'h1' || chr(10) || 'h2', NULL FROM part""")
def record_rows(spark, sf):
    return E.record_rows(record_pages(spark, sf))


def quest_pages(spark, sf):
    """Quest pages derived from the documents: a sentence, a release and a description."""
    docs = staging.pages_plain(spark, sf)
    nl = F.lit("\n")
    w = F.split("page_title", " ")
    text = F.concat(
        F.lit("**"), F.get(w, F.lit(0)), F.lit("** is the "), F.element_at(F.array(
            F.lit("third main"), F.lit("side"), F.lit("bonus")), (F.col("page_id") % 3 + 1).cast("int")),
        F.lit(" Quest, released in Update "), (F.col("page_id") % 40).cast("string"),
        F.lit(".2 (2024-01-02)."), nl, F.lit('> "'), F.element_at(T.lines(F.col("content_markdown")), 1),
        F.lit('"'), nl, F.lit("Quest Description"), nl, F.col("content_markdown"))
    title = F.when(F.col("page_id") % 7 == 0, F.concat("page_title", F.lit("/Walk"))).otherwise(
        F.replace("page_title", F.lit("/"), F.lit("-")))
    return docs.select("page_id", title.alias("page_title"), text.alias("content_markdown"))


@query("quest_rows", f"""
SELECT page_id, {strip_sql("split_part(page_title, ' ', 1)")} AS quest_name,
  CASE page_id % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'side' END AS quest_type,
  'Update ' || page_id % 40 || '.2 (2024-01-02)' AS release_note,
  nullif({strip_sql(chain_sql("split_part(text, chr(10), 1)", (('"+$', ''),)))}, '') AS quest_context
FROM (SELECT doc_id AS page_id, text, {S.TITLE} AS page_title FROM documents) WHERE page_id % 7 <> 0""")
def quest_rows(spark, sf):
    return E.quest_rows(quest_pages(spark, sf))


def update_pages(spark, sf):
    """Patch pages derived from the documents."""
    docs = staging.pages_plain(spark, sf)
    nl = F.lit("\n")
    text = F.concat(
        F.lit("Site: "), "page_title", nl, F.when(F.col("page_id") % 2 == 0, "Hotfix").otherwise(
            "# Head"), nl, F.lit("Tweet"), nl, F.lit("Jan 5, 2024"), nl, F.lit("**Bold head**"), nl,
        F.lit("- skip"), nl, F.col("content_markdown"), nl, F.lit("## End"), nl, F.lit("tail"))
    return docs.select("page_id", F.concat(F.lit("/patch/pc/"), F.col("page_id").cast("string"),
                                           F.lit("-1-0")).alias("page_title"),
                       text.alias("content_markdown"))


_BODY = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


_SKIP = "(regexp_matches(x, '^[#-]') OR x = 'Tweet')"


@query("update_rows", f"""
WITH l AS (SELECT doc_id, {strip_sql(S.TITLE)} AS title,
    list_concat({_BODY}, ['## End', 'tail']) AS body FROM documents),
a AS (SELECT doc_id, title, body[list_position(list_transform(body, lambda x: NOT {_SKIP}), true):]
    AS body FROM l),
p AS (SELECT *, list_position(list_transform(body, lambda x: {_SKIP}), true) AS stop FROM a)
SELECT doc_id AS page_id, doc_id || '.1.0' AS version,
  CASE WHEN title = '' THEN 'Site:' ELSE title END AS update_title,
  CASE WHEN doc_id % 2 = 0 THEN 'Hotfix' END AS update_type, 'Jan 5, 2024' AS release_date,
  CASE WHEN doc_id % 2 = 0 THEN array_to_string(
      body[1:coalesce(nullif(stop, 0) - 1, len(body))], chr(10))
    ELSE 'Jan 5, 2024' || chr(10) || '**Bold head**' END AS summary
FROM p""")
def update_rows(spark, sf):
    return E.update_rows(update_pages(spark, sf), "Site")


def announcement_pages(spark, sf):
    docs = staging.pages_plain(spark, sf)
    nl = F.lit("\n")
    text = F.concat(F.lit("Site: x"), nl, F.lit("Tweet"), nl, F.lit("T "), "page_title", nl,
                    F.lit("pc"), nl, F.lit("Sub"), nl, F.lit("Publié sur 2024-01-02 10:00"), nl,
                    F.col("content_markdown"))
    return docs.select("page_id", F.lit("/news/a-b").alias("page_title"), text.alias("content_markdown"))


_ART = "(length(x) < 2 OR regexp_matches(x, '^(?:[#-].*|Tweet|Publié sur.*|pc|ps4|ps5|xbox|switch)$'))"


@query("announcement_rows", f"""
SELECT doc_id AS page_id, {strip_sql("'T ' || " + S.TITLE)} AS title, 'Sub' AS subtitle,
  '2024-01-02 10:00' AS published_at,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip_sql('x')}),
    lambda x: length(x) > 25 AND NOT {_ART})[1] AS summary FROM documents""")
def announcement_rows(spark, sf):
    return E.announcement_rows(announcement_pages(spark, sf), "Site")


def variant_pages(spark, sf):
    """Directory pages derived from the parts."""
    part = staging.table(spark, sf, "part")
    nl = F.lit("\n")
    name = F.concat(F.initcap("p_name"), F.lit(" "), F.col("p_partkey").cast("string"))
    text = F.concat(F.lit("Item: "), name, nl, name, nl, F.col("p_brand"), F.lit(" made of "),
                    F.lower("p_type"), nl, name, F.lit(" Prime"), nl, F.when(
                        F.col("p_size") > 25, F.concat(F.lit("Golden form of "), "p_name")).otherwise("short"))
    title = F.concat(F.lit("/items/"), F.col("p_partkey").cast("string"), F.when(
        F.col("p_size") % 10 == 0, "-prime").otherwise(""))
    return part.select(F.col("p_partkey").alias("page_id"), title.alias("page_title"),
                       text.alias("content_markdown"))


@query("variant_rows", """
WITH v AS (SELECT p_partkey AS page_id, p_size, p_brand || ' made of ' || lower(p_type) AS d,
  'Golden form of ' || p_name AS g, p_name FROM part)
SELECT page_id, false AS is_prime, CASE WHEN length(d) >= 15 THEN d END AS description FROM v WHERE p_size % 10 <> 0
UNION ALL SELECT page_id, true, g FROM v WHERE p_size > 25""")
def variant_rows(spark, sf):
    return E.variant_rows(variant_pages(spark, sf)).drop("frame_name")


@query("variants_first_wins", """
SELECT name, min(page_id) AS page_id, count(*) AS copies FROM (
  SELECT lower(p_name) AS name, p_partkey AS page_id FROM part) GROUP BY name""")
def variants_first_wins(spark, sf):
    """First page that claims a directory name, with the number of pages claiming it."""
    named = staging.table(spark, sf, "part").select(
        F.lower("p_name").alias("name"), F.col("p_partkey").alias("page_id"))
    first = ordered.first_wins(named, ["name"], [F.col("page_id").asc()])
    return first.join(named.groupBy("name").agg(F.count("*").alias("copies")), "name")


def structured_rows(spark, sf) -> DataFrame:
    """Rows of all seven kinds rendered as (kind, source_id, title, content)."""
    part = staging.table(spark, sf, "part")
    orders = staging.table(spark, sf, "orders")
    lines = staging.dialogue_lines(spark, sf)
    null = F.lit(None).cast("string")
    variants = part.select(
        "p_partkey", F.col("p_name").alias("frame_name"), (F.col("p_size") > 25).alias("is_prime"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("description"))
    quests = part.select(
        "p_partkey", F.col("p_name").alias("quest_name"), F.col("p_type").alias("quest_type"),
        F.when(F.col("p_size") > 10, F.col("p_brand")).alias("release_note"),
        F.lit("").alias("quest_context"))
    updates = orders.select(
        "o_orderkey", F.col("o_orderkey").cast("string").alias("version"),
        F.col("o_orderpriority").alias("update_title"), F.col("o_orderstatus").alias("update_type"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("release_date"), null.alias("summary"))
    news = orders.select(
        "o_orderkey", F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("subtitle"),
        null.alias("published_at"), F.lit("text").alias("summary"))
    records = part.select(
        "p_partkey", F.col("p_name").alias("item_name"), F.col("p_type").alias("series"),
        F.when(F.col("p_size") < 10, F.col("p_brand")).alias("narrator"), null.alias("planet"),
        F.col("p_name").alias("item_text"), F.col("p_brand").alias("secret_text"))
    said = lines.select(
        "page_id", "message_order", F.lit("quote").alias("dialogue_kind"), null.alias("context"),
        F.when(F.col("player_choice"), "C1").alias("chapter"), "speaker", "message_text")
    chat = said.withColumn("dialogue_kind", null)
    line_id = F.concat_ws(":", F.col("page_id").cast("string"), F.col("message_order").cast("string"))
    pid, oid = F.col("p_partkey").cast("string"), F.col("o_orderkey").cast("string")
    parts = [E.render_rows("variants", variants, pid), E.render_rows("quests", quests, pid),
             E.render_rows("updates", updates, oid), E.render_rows("announcements", news, oid),
             E.render_rows("records", records, pid), E.render_rows("dialogues", said, line_id),
             E.render_rows("chat_dialogues", chat, line_id)]
    return reduce(DataFrame.unionByName, parts)


@query("render_rows", f"""
WITH {S.LINES}
SELECT 'variants' AS kind, p_partkey::VARCHAR AS source_id,
  p_name || CASE WHEN p_size > 25 THEN ' Prime' ELSE '' END AS title,
  'Variante: ' || p_name || CASE WHEN p_size > 25 THEN ' Prime' ELSE '' END ||
    CASE WHEN p_size % 2 = 0 THEN '. ' || p_type ELSE '' END AS content FROM part
UNION ALL SELECT 'quests', p_partkey::VARCHAR, p_name, concat_ws(' — ', 'Quête : ' || p_name,
  'Type : ' || p_type, CASE WHEN p_size > 10 THEN p_brand END) FROM part
UNION ALL SELECT 'updates', o_orderkey::VARCHAR, 'Mise à jour ' || o_orderkey, concat_ws(' — ',
  'Version ' || o_orderkey, o_orderpriority, '(' || o_orderstatus || ')',
  'Date : ' || strftime(o_orderdate, '%Y-%m-%d')) FROM orders
UNION ALL SELECT 'announcements', o_orderkey::VARCHAR, o_orderpriority,
  concat_ws(' — ', 'Annonce : ' || o_orderpriority, o_orderstatus, 'text') FROM orders
UNION ALL SELECT 'records', p_partkey::VARCHAR, p_name || ' (' || p_type || ')', concat_ws(' — ',
  'Fragment : ' || p_name, 'Série : ' || p_type, CASE WHEN p_size < 10 THEN 'Narrateur : ' || p_brand END,
  p_name, 'Texte caché : ' || p_brand) FROM part
UNION ALL SELECT 'dialogues', page_id || ':' || message_order, 'quote — ' || speaker,
  concat_ws(' ', '[quote]', CASE WHEN player_choice THEN 'Chapitre : C1' END,
  speaker || ' : ' || message_text) FROM lines
UNION ALL SELECT 'chat_dialogues', page_id || ':' || message_order, 'chat — ' || speaker,
  concat_ws(' ', '[chat]', CASE WHEN player_choice THEN 'Chapitre : C1' END,
  speaker || ' : ' || message_text) FROM lines""")
def render_rows(spark, sf):
    return structured_rows(spark, sf)


@query("source_urls", f"""
WITH p AS (SELECT page_id, url, {_P} AS path FROM pages)
SELECT page_id, CASE page_id % 3 WHEN 0 THEN url
  WHEN 1 THEN CASE WHEN ends_with('https://h.example' || regexp_replace(path, '/+$', ''), regexp_replace(path, '/+$', ''))
    THEN 'https://h.example' || regexp_replace(path, '/+$', '') ELSE '' END
  ELSE 'https://h.example/wiki/My_Page_' || page_id END AS source_url FROM p""")
def source_urls(spark, sf):
    k = F.col("page_id") % 3
    path = F.regexp_extract("url", r"^https?://[^/]+([^?#]*)", 1)
    canonical = F.when(k == 0, F.col("url"))
    base = F.when(k == 1, F.concat(F.lit("https://h.example"), path)).otherwise("https://h.example/wiki/")
    title = F.when(k == 1, path).otherwise(F.concat(F.lit("My Page "), F.col("page_id").cast("string")))
    return staging.table(spark, sf, "pages").select(
        "page_id", E.source_url(canonical, base, title).alias("source_url"))


@query("reading_messages")
def reading_messages(spark, sf):
    return E.reading_messages(chat_pages(spark, sf))


@query("page_flags", f"""
WITH {S.CHAT}, d AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN content_markdown || chr(10) ||
  '> *_SPOILERS_* _: ' || page_id || '_' ELSE content_markdown END AS t FROM chat),
r AS (SELECT page_id, list_transform(string_split(t, chr(10)), lambda x: {strip_sql('x')}) AS ls FROM d)
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN page_id::VARCHAR END AS spoiler,
  len(list_filter(list_slice(ls, 1, 200), lambda x: starts_with(x, '> **'))) > 0 AS dialogue FROM r""")
def page_flags(spark, sf):
    warned = F.when(F.col("page_id") % 4 == 0, F.concat(
        "content_markdown", F.lit("\n> *_SPOILERS_* _: "), F.col("page_id").cast("string"), F.lit("_"))
    ).otherwise(F.col("content_markdown"))
    return chat_pages(spark, sf).select("page_id", E.page_flags(warned).alias("f")).select(
        "page_id", "f.spoiler", "f.dialogue")


def ranked_pages(spark, sf):
    """Chat pages with rank headings and sections, derived from the documents."""
    def mark(line, i):
        w0 = F.get(F.split(line, " "), F.lit(0))
        return (
            F.when(i % 10 == 2, F.concat(F.lit("## Rank "), (i / 10).cast("int").cast("string"),
                                         F.lit(" - "), w0, F.lit("\n"), line))
            .when(i % 10 == 4, F.concat(F.lit("### Conversation "), i.cast("string"), F.lit("\n"), line))
            .when(i % 10 == 7, F.concat(F.lit("### The end\n> "), line))
            .otherwise(F.concat(F.lit("> "), line)))
    text = F.array_join(F.transform(T.lines(F.col("text")), mark), "\n")
    return staging.table(spark, sf, "documents").select(
        F.col("doc_id").alias("page_id"), F.concat(F.lit("chat/"), "source").alias("page_title"),
        text.alias("content_markdown"))


@query("split_conversations")
def split_conversations(spark, sf):
    return E.split_conversations(ranked_pages(spark, sf))


def patch_pages(spark, sf):
    """Pages with a version history, derived from the documents."""
    def mark(line, i):
        return (
            F.when(i == 1, F.concat(line, F.lit("\n## Patch History")))
            .when(i % 5 == 2, F.concat(F.lit("**Update "), i.cast("string"), F.lit(".1**\n* "), line))
            .when(i % 5 == 3, F.lit("[ref]"))
            .when(i == 16, F.concat(F.lit("## Other\n"), line))
            .otherwise(F.concat(F.lit("> {x}"), line)))
    return staging.table(spark, sf, "documents").select(
        F.col("doc_id").alias("page_id"), F.array_join(
            F.transform(T.lines(F.col("text")), mark), "\n").alias("content_markdown"))


@query("version_notes")
def version_notes(spark, sf):
    return E.version_notes(patch_pages(spark, sf)).select(
        "page_id", "version_no", "version", F.array_join("notes", " | ").alias("notes"))


@query("page_body")
def page_body(spark, sf):
    """Page text left for display once the version notes are split off."""
    return patch_pages(spark, sf).select(
        "page_id", E.without_version_notes(F.col("content_markdown")).alias("body"))


@query("route_dispatch", f"""
WITH p AS (SELECT page_id, {_P} AS path FROM pages)
SELECT page_id, CASE WHEN starts_with(path, '/en/') THEN 'variants' WHEN starts_with(path, '/fr/') THEN 'updates'
  WHEN starts_with(path, '/de/') THEN 'announcements' ELSE 'none' END AS route,
  NOT contains(trim(path, '/'), '/') AS top_level FROM p""")
def route_dispatch(spark, sf):
    path = F.regexp_extract("url", r"^https?://[^/]+([^?#]*)", 1)
    routes = (("/en/", "variants"), ("/fr/", "updates"), ("/de/", "announcements"))
    route = F.coalesce(*[F.when(F.startswith(path, F.lit(p)), F.lit(r)) for p, r in routes],
                       F.lit("none"))
    return staging.table(spark, sf, "pages").select(
        "page_id", route.alias("route"),
        (~F.contains(F.btrim(path, F.lit("/")), F.lit("/"))).alias("top_level"))
