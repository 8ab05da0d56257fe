"""Cleaning job: each stage of the markup chain, the whole chain, and text scalars."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from foliant import staging
from foliant.functions import html as H
from foliant.functions import messages as M
from foliant.functions import text as T
from foliant.functions import wikitext as X
from foliant.plans import sql as S
from foliant.plans.registry import query


def lit_sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def chain_sql(expr: str, rules) -> str:
    """The rule chain of ``foliant.functions.text.chain`` as nested regexp_replace calls."""
    for pattern, repl in rules:
        repl = re.sub(r"\$(\d)", r"\\\1", repl)
        expr = f"regexp_replace({expr}, {lit_sql(pattern)}, {lit_sql(repl)}, 'g')"
    return expr


STRIP = ((r"^\s+|\s+$", ""),)


def strip_sql(expr: str) -> str:
    return chain_sql(expr, STRIP)


def stage(name: str, fn, rules):
    """Register one cleaning stage over the whole wikitext corpus."""

    @query(name, f"WITH {S.WIKI} SELECT page_id, {chain_sql('wikitext', rules)} AS cleaned FROM wiki")
    def run(spark, sf):
        return staging.wiki_pages(spark, sf).select(
            "page_id", fn(F.col("wikitext")).alias("cleaned"))

    return run


stage("strip_tables_code", X.strip_blocks, X.BLOCK_RULES)
stage("convert_tags", X.convert_tags, X.TAG_RULES)
stage("strip_references", X.strip_references, (*X.TRANSCLUSION_RULES, *X.FILE_RULES,))
stage("emphasis", X.emphasis, X.EMPHASIS_RULES)
stage("protect_bullets", X.protect_bullets, ((r"(?m)^\*+[ \t]*", X.BULLET),))
stage("normalise_links", X.normalise_links, X.LINK_RULES)
stage("reflow_headings", X.reflow_headings, X.HEADING_RULES)
stage("indentation", X.indentation, X.INDENT_RULES)
stage("collapse_galleries", X.collapse_galleries, X.GALLERY_RULES)
stage("collapse_blank_lines", X.collapse_blank_lines, X.BLANK_RULES)
stage("render_narrative", X.render_narrative, X.NARRATIVE_RULES)
stage("drop_noise", X.drop_noise, X.NOISE_RULES)
# The pages of this check nest at most three deep; the SQL spells out eight passes.
stage("flatten_templates", X.flatten_templates, (*X.NOISE_RULES, *X.FLATTEN_RULES) * 8)


@query("template_signals", f"""
WITH {S.WIKI} SELECT page_id,
  regexp_matches(wikitext, '(?i)\\{{\\{{\\s*(speculation|conjecture|theory)\\s*[|}}]') AS non_canon,
  regexp_matches(wikitext, '(?i)\\{{\\{{\\s*(canon|confirmed|in-game)\\s*[|}}]') AS canon,
  len(regexp_extract_all(wikitext, '\\{{\\{{'))::INTEGER AS templates FROM wiki""")
def template_signals(spark, sf):
    w = F.col("wikitext")
    return staging.wiki_pages(spark, sf).select(
        "page_id", X.has_non_canon(w).alias("non_canon"), X.has_canon(w).alias("canon"),
        X.template_residue(w).alias("templates"))


@query("gameplay_sections")
def gameplay_sections(spark, sf):
    pages = staging.wiki_pages(spark, sf).select("page_id", F.col("wikitext").alias("cleaned"))
    return X.drop_gameplay(pages, "cleaned")


_L = "list_transform(string_split(t, chr(10)), lambda x: " + strip_sql("x") + ")"
_SAID = chain_sql(chain_sql("x", ((X.BULLET + r"|\*\*+|_+", ""),)), STRIP)
_SAID = chain_sql(_SAID, (('^"|"$', ""),))


@query("dialogue_format", f"""
WITH {S.WIKI}, w AS (SELECT page_id, string_split({chain_sql('wikitext', ((r"(?m)^[*]+[ \t]*", X.BULLET),))},
    chr(10)) AS ls FROM wiki),
r AS (SELECT page_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM w),
s AS (SELECT page_id, n, line, {strip_sql('line')} AS x FROM r),
u AS (SELECT *, lag(starts_with(x, chr(1))) OVER (PARTITION BY page_id ORDER BY n) AS after_bullet,
  {_SAID} AS said FROM s),
v AS (SELECT page_id, n, CASE
  WHEN starts_with(x, chr(1)) AND contains(said, ':') THEN '> **' ||
    {strip_sql("split_part(said, ':', 1)")} || ':** ' ||
    {chain_sql(strip_sql("substr(said, instr(said, ':') + 1)"), (('^"|"$', ''),))}
  WHEN starts_with(x, chr(1)) THEN '> ' || {strip_sql('said')}
  WHEN x = '' THEN NULL WHEN after_bullet THEN chr(10) || line ELSE line END AS o FROM u)
SELECT w.page_id, coalesce(string_agg(o, chr(10) ORDER BY n), '') AS formatted
FROM w LEFT JOIN v ON w.page_id = v.page_id GROUP BY w.page_id""")
def dialogue_format(spark, sf):
    return staging.wiki_pages(spark, sf).select(
        "page_id", X.format_dialogue(X.protect_bullets(F.col("wikitext"))).alias("formatted"))


def chat_text(text):
    """Dialogue markup with navigation notes, derived from plain lines."""
    def mark(line, i):
        w0 = F.get(F.split(line, " "), F.lit(0))
        k = i % 6
        return (
            F.when(k == 0, F.concat(F.lit("> **{If "), w0, F.lit("} "), w0, F.lit(":** "), line))
            .when(k == 1, F.concat(F.lit("> **{Continues as above from "), w0, F.lit(" "), line))
            .when(k == 2, F.concat(F.lit("> "), w0, F.lit(": "), line, F.lit(" {Same as below}")))
            .when(k == 3, F.concat(F.lit("> > "), line, F.lit(" {P"), i.cast("string"), F.lit("}\n[Convo. ends]")))
            .when(k == 4, F.concat(F.lit("> **"), w0, F.lit(":** "), line,
                                   F.lit(" {Convo. ends. Jump}")))
            .otherwise(F.concat(F.lit("## Chapter "), w0, F.lit("\n"), line)))
    return F.array_join(F.transform(T.lines(text), mark), "\n")


def chat_pages(spark, sf):
    docs = staging.spread(staging.table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select(
        F.col("doc_id").alias("page_id"), staging.page_title(F.col("text")).alias("page_title"),
        chat_text(F.col("text")).alias("content_markdown"))


@query("strip_instructions")
def strip_instructions(spark, sf):
    return chat_pages(spark, sf).select(
        "page_id", X.strip_instructions(F.col("content_markdown")).alias("cleaned"))


_FOOT = """feet AS (SELECT doc_id AS page_id, array_to_string(list_transform(string_split(text, chr(10)),
  lambda x, i: CASE WHEN (i - 1) % 11 = 7 THEN ' Update ' || i || chr(10) || x ELSE x END), chr(10)) AS t
  FROM documents)"""


def footed(spark, sf):
    rows = F.transform(F.split("text", "\n"), lambda x, i: F.when(
        i % 11 == 7, F.concat(F.lit(" Update "), (i + 1).cast("string"), F.lit("\n"), x)).otherwise(x))
    return staging.table(spark, sf, "documents").select(
        F.col("doc_id").alias("page_id"), F.array_join(rows, "\n").alias("t"))


@query("footer_cut", f"""
WITH {_FOOT}, a AS (SELECT page_id, t, list_position(list_transform(string_split(t, chr(10)),
  lambda x: regexp_matches({strip_sql('x')}, {lit_sql(X.FOOTER_LINE)})), true) AS k FROM feet)
SELECT page_id, CASE WHEN coalesce(k, 0) <= 1 THEN t ELSE regexp_replace(array_to_string(
  list_slice(string_split(t, chr(10)), 1, k - 1), chr(10)), '\\s+\\z', '') || chr(10) END AS cleaned
FROM a""")
def footer_cut(spark, sf):
    return footed(spark, sf).select("page_id", X.cut_footer(F.col("t")).alias("cleaned"))


_BODY = f"CASE WHEN starts_with({strip_sql('x')}, '>') THEN {strip_sql('substr(' + strip_sql('x') + ', 2)')} ELSE {strip_sql('x')} END"
_B1 = chain_sql(_BODY, ((r"^\*\*[^*]*\*\*\s*:?\s*$", ""),))
_LABEL = (f"(regexp_matches({_B1}, {lit_sql(chr(94) + '[A-Za-z][' + chr(92) + 'w' + chr(39) + ' -]*:' + chr(92) + 's*$')})"
          f" AND NOT regexp_matches({_B1}, {lit_sql('[ -]+[^A-Za-z: ]|[ -][ -]+[A-Za-z]|-' + chr(92) + 's*:')}))")
_REST = strip_sql(chain_sql(_B1, ((r"[>*_:.\"'–—-]", ""),)))


@query("audio_strip", f"""
WITH {S.WIKI}
SELECT page_id, array_to_string(list_filter(string_split({chain_sql('wikitext', X.AUDIO_RULES)}, chr(10)),
  lambda x: NOT {_LABEL} AND {_REST} <> ''), chr(10)) AS cleaned FROM wiki""")
def audio_strip(spark, sf):
    return staging.wiki_pages(spark, sf).select(
        "page_id", X.strip_audio(F.col("wikitext")).alias("cleaned"))


@query("clean_pages")
def clean_pages(spark, sf):
    """The whole cleaning chain, short results dropped as at ingest."""
    cleaned = X.clean_pages(staging.wiki_pages(spark, sf))
    return cleaned.filter(F.length("markdown") >= 20).select(
        "page_id", "page_title", "non_canon", "canon", "markdown")


@query("html_to_markdown")
def html_to_markdown(spark, sf):
    pages = staging.spread(staging.table(spark, sf, "pages").select("page_id", "html"))
    return pages.select("page_id", H.html_to_markdown("html").alias("markdown"))


_DROP = "nav|footer|header|aside|script|style|form|button"
HTML_RULES = (
    *[(rf"(?is)<{t}\b[^>]*>.*?</{t}>", "") for t in _DROP.split("|")],
    (r"(?s)<!--.*?-->", ""), (r"(?is)^.*?<body[^>]*>", ""), (r"\s+", " "),
    *[(rf"(?i)<h{n}[^>]*>", "\n" + "#" * n + " ") for n in range(1, 7)],
    (r"(?i)<li[^>]*>", "\n- "), (r"(?i)<br[^>]*>", "\n"), (r"(?i)</?(?:strong|b)>", "**"),
    (r"(?i)</?(?:em|i)>", "*"), (r"(?i)</?(?:p|div|article|section|ul|ol|h[1-6])[^>]*>", "\n"),
    (r"<[^>]+>", ""), (r"(?m)^[ \t]+|[ \t]+$", ""), (r"\n{2,}", "\n"), (r"\A\n|\n\z", ""),
)


@query("html_to_text", f"SELECT page_id, {chain_sql('html', HTML_RULES)} AS body FROM pages")
def html_to_text(spark, sf):
    """Pattern-only form of the HTML conversion: approximate, but all inside the JVM."""
    return staging.table(spark, sf, "pages").select(
        "page_id", T.chain(F.col("html"), HTML_RULES).alias("body"))


@query("wiki_sections", f"""
WITH {S.WIKI}, a AS (SELECT page_id, string_split({chain_sql(chain_sql('wikitext', M.SECTION_RULES), ())},
  chr(10)) AS ls FROM wiki)
SELECT page_id, array_to_string(list_filter(ls, lambda x: NOT regexp_matches(x, '^#{{4,6}} ')), chr(10))
  AS markdown FROM a""")
def wiki_sections(spark, sf):
    """Wikitext reduced to level 2-3 sections without templates."""
    rows = T.lines(T.chain(F.col("wikitext"), M.SECTION_RULES))
    return staging.wiki_pages(spark, sf).select("page_id", F.array_join(F.filter(
        rows, lambda x: ~F.rlike(x, F.lit("^#{4,6} "))), "\n").alias("markdown"))


@query("infobox_fields", f"""
WITH b AS (SELECT p_partkey AS page_id, '{{{{Infobox item' || chr(10) || '| name = ' || p_name || chr(10) ||
  '|brand=' || p_brand || chr(10) || '| size = ' || p_size || chr(10) || '| note = ' || chr(10) || '}}}}' AS w
  FROM part)
SELECT page_id, trim(unnest(regexp_extract_all(w, '(?m)^\\|\\s*([A-Za-z_]+)\\s*=\\s*([^\\n]*[^\\s])', 1))) AS field,
  trim(unnest(regexp_extract_all(w, '(?m)^\\|\\s*([A-Za-z_]+)[ \\t]*=[ \\t]*([^\\n]*[^\\s])', 2))) AS field_value
FROM b""".replace("\\s*([^\\n]*[^\\s])', 1", "\\s*([^\\n]*[^\\s])', 1").replace(
    "\\s*=\\s*([^\\n]*[^\\s])', 1", "[ \\t]*=[ \\t]*([^\\n]*[^\\s])', 1"))
def infobox_fields(spark, sf):
    part = staging.spread(staging.table(spark, sf, "part").select(
        "p_partkey", "p_name", "p_brand", "p_size"))
    w = F.concat(F.lit("{{Infobox item\n| name = "), "p_name", F.lit("\n|brand="), "p_brand",
                 F.lit("\n| size = "), F.col("p_size").cast("string"), F.lit("\n| note = \n}}"))
    boxes = T.once(part.select(F.col("p_partkey").alias("page_id"), w.alias("w")), "box",
                   M.infobox(F.col("w")))
    return boxes.select("page_id", F.explode("box").alias("field", "field_value"))


@query("page_view")
def page_view(spark, sf):
    """Display form of a page: flat headings, no footer, version notes split off."""
    from foliant.operators.extract import version_notes, without_version_notes
    pages = staging.wiki_pages(spark, sf).select("page_id", F.concat(
        "wikitext", F.lit("\n== Patch History ==\nUpdate 1.2\n* Fixed.\n")).alias("content_markdown"))
    flat = T.once(pages, "content_markdown", X.reflow_headings(F.col("content_markdown")))
    notes = version_notes(flat).groupBy("page_id").agg(F.count("*").alias("versions"))
    body = X.cut_footer(without_version_notes(F.col("content_markdown")))
    return flat.select("page_id", body.alias("body")).join(notes, "page_id", "left").select(
        "page_id", "body", F.coalesce("versions", F.lit(0)).alias("versions"))


# --- scalars over messages and titles ---

_JUNK = "|".join(M.JUNK_WORDS)


@query("junk_filter", f"""
WITH {S.LINES}, d AS (SELECT page_id, message_order, speaker,
  CASE WHEN message_order % 4 = 1 THEN 'Update: ' || message_text
       WHEN message_order % 4 = 2 THEN message_order || '%' ELSE message_text END AS msg FROM lines)
SELECT page_id, message_order, regexp_matches({strip_sql('msg')}, {lit_sql(M.NUMERIC_ONLY)})
  OR regexp_matches(speaker, {lit_sql(M.JUNK_IN_SPEAKER)})
  OR regexp_matches(msg, {lit_sql(M.JUNK_LABEL)}) AS junk FROM d""")
def junk_filter(spark, sf):
    k = F.col("message_order") % 4
    msg = F.when(k == 1, F.concat(F.lit("Update: "), "message_text")).when(
        k == 2, F.concat(F.col("message_order").cast("string"), F.lit("%"))).otherwise(
        F.col("message_text"))
    return staging.dialogue_lines(spark, sf).select(
        "page_id", "message_order", M.is_junk(F.col("speaker"), msg).alias("junk"))


_SPK = "split_part(split_part(text, chr(10), 1), ',', 1)"


@query("speaker_names", f"""
SELECT doc_id AS page_id, {_SPK} AS candidate,
  length({_SPK}) <= 40 AND NOT regexp_matches({_SPK}, '[*_\\]}}:]') AND
    regexp_matches({_SPK}, '^\\p{{Lu}}') AS is_name,
  length({_SPK}) <= 24 AND NOT regexp_matches({_SPK}, '[*_\\]}}(\\[>.,?!]') AND
    regexp_matches({_SPK}, '^\\p{{Lu}}') AS is_strict_name
FROM documents""")
def speaker_names(spark, sf):
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    return staging.table(spark, sf, "documents").select(
        F.col("doc_id").alias("page_id"), F.split_part(first, F.lit(","), F.lit(1)).alias("candidate")
    ).select("page_id", "candidate", M.is_speaker(F.col("candidate")).alias("is_name"),
             M.is_speaker_strict(F.col("candidate")).alias("is_strict_name"))


@query("title_keys", f"""
WITH {S.PAGES_MD}
SELECT page_id, lower(trim(regexp_replace(page_title, '\\s+', ' ', 'g'))) AS title_key,
  translate(lower(page_title), 'àâäáãåçèéêëẽíìîïñòóôõöùúûüýÿ', 'aaaaaaceeeeeiiiinooooouuuuyy') AS folded,
  translate(bucket_id, '310457', 'eloast') AS unleet, page_title || ' (fr)' AS mirror_title,
  page_title AS raw_title, regexp_replace(page_title, '[^A-Za-z0-9]+', '', 'g') AS slug FROM pages_md""")
def title_keys(spark, sf):
    t = F.col("page_title")
    mirror = T.add_suffix(t)
    return staging.pages_plain(spark, sf).select(
        "page_id", T.normalize_key(t).alias("title_key"),
        T.fold_accents(F.lower(t)).alias("folded"), T.fold_leet(F.col("bucket_id")).alias("unleet"),
        mirror.alias("mirror_title"), T.drop_suffix(mirror).alias("raw_title"),
        M.slug(t).alias("slug"))


@query("texture_files", """
SELECT p_partkey, regexp_replace(replace(f, '!00_', '__00_'), '[^A-Za-z0-9_.+-]', '_', 'g') AS file_name
FROM (SELECT p_partkey, replace(p_name, ' ', '&') || CASE WHEN p_size % 2 = 0
  THEN '.png!00_' || p_brand ELSE '.png' END AS f FROM part)""")
def texture_files(spark, sf):
    part = staging.table(spark, sf, "part")
    loc = F.concat(F.lit("/assets/"), "p_type", F.lit("/"), F.replace(
        F.col("p_name"), F.lit(" "), F.lit("&")), F.when(F.col("p_size") % 2 == 0, F.concat(
            F.lit(".png!00_"), "p_brand")).otherwise(F.lit(".png")))
    return part.select("p_partkey", T.sanitize_filename(loc).alias("file_name"))


@query("route_ids")
def route_ids(spark, sf):
    path = F.regexp_extract("url", r"^https?://[^/]+([^?#]*)", 1)
    return staging.table(spark, sf, "pages").select(
        "page_id", T.route_id(path).alias("fr_id"), T.route_id(path, "en").alias("en_id"),
        T.mirror_id(path).alias("mirror_id"))


@query("iso_dates", """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE epoch_us(o_orderdate) END AS us FROM orders""")
def iso_dates(spark, sf):
    text = F.when(F.col("o_orderkey") % 10 == 3, F.lit("not a date")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return staging.table(spark, sf, "orders").select(
        "o_orderkey", F.unix_micros(T.parse_iso(text)).alias("us"))


@query("sanitize_queries", """
SELECT conv_id, turn, substr(trim(regexp_replace(
  replace('<@12> ' || text || chr(7) || ' end', '<@12>', 'un utilisateur'),
  '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\s]+', ' ', 'g')), 1, 2000) AS query_text FROM conversations""")
def sanitize_queries(spark, sf):
    raw = F.concat(F.lit("<@12> "), F.col("text"), F.lit("\u0007 end"))
    return staging.table(spark, sf, "conversations").select(
        "conv_id", "turn", T.sanitize_query(raw).alias("query_text"))


_BASE = "replace(replace(d, '**', ''), '~', '')"


@query("dialogue_refs", f"""
WITH d AS (SELECT conv_id, turn, '> ' || text || ' {{If x}} {{P2}} {{Convo ends.}}...' AS d FROM conversations)
SELECT conv_id, turn,
  trim(regexp_replace(regexp_replace(regexp_replace(d, '(?i)\\{{\\s*if\\s+[^{{}}]*\\}}', '', 'g'),
    '(?i)\\{{P\\d+\\}}', '', 'g'), '\\s+', ' ', 'g')) AS display_text,
  substr(trim(regexp_replace(regexp_replace(lower(d), '(?i)\\{{convo[^}}\\n]{{0,16}}ends\\.?\\}}', '', 'g'),
    '\\s+', ' ', 'g')), 1, 120) AS graph_ref,
  {strip_sql(chain_sql("lower(d)", M.SCRIPT_REF_RULES))} AS script_ref
FROM d""")
def dialogue_refs(spark, sf):
    d = F.concat(F.lit("> "), F.col("text"), F.lit(" {If x} {P2} {Convo ends.}..."))
    return staging.table(spark, sf, "conversations").select(
        "conv_id", "turn", M.display_text(d).alias("display_text"), M.graph_ref(d).alias("graph_ref"),
        M.script_ref(d).alias("script_ref"))


@query("trailing_padding", """
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN regexp_replace(text, '[*\\-\\s]+\\z', '')
  WHEN turn % 3 = 1 AND regexp_matches(regexp_replace(text, '[.,]+\\z', ''), '[\\p{L}\\p{N}]\\z')
    THEN regexp_replace(text, '[.,]+\\z', '') || '**'
  WHEN turn % 3 = 1 THEN regexp_replace(regexp_replace(text, '[.,]+\\z', ''), '[*\\-\\s]+\\z', '') ELSE regexp_replace(text, '[*\\-\\s]+\\z', '') END AS cleaned,
  turn % 3 = 1 AS closed
FROM conversations""")
def trailing_padding(spark, sf):
    turns = staging.table(spark, sf, "conversations")
    bare = F.regexp_replace("text", r"[.,]+\z", "")
    k = F.col("turn") % 3
    padded = F.when(k == 0, F.concat("text", F.lit(" *-"))).when(
        k == 1, F.concat(bare, F.lit("**"))).otherwise(F.concat("text", F.lit(" \n")))
    return turns.select(
        "conv_id", "turn", T.strip_padding(padded).alias("cleaned"), (k == 1).alias("closed"))


@query("message_lines", """
SELECT conv_id, turn, len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)),
  lambda x: x <> ''))::INTEGER AS n_lines, array_to_string(list_filter(list_transform(
  string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' / ') AS joined FROM conversations""")
def message_lines(spark, sf):
    rows = T.clean_lines(F.col("text"))
    return staging.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.size(rows).alias("n_lines"), F.array_join(rows, " / ").alias("joined"))


@query("word_counts", """
SELECT doc_id AS page_id, CASE WHEN trim(text) = '' THEN 0 ELSE len(regexp_split_to_array(
  regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+')) END::BIGINT AS words,
  (length(text) // 4)::BIGINT AS tokens FROM documents""")
def word_counts(spark, sf):
    return staging.table(spark, sf, "documents").select(
        F.col("doc_id").alias("page_id"), T.word_count(F.col("text")).alias("words"),
        T.token_estimate(F.col("text")).alias("tokens"))
