"""Chunking job, vocabulary and corpus exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant import staging
from foliant.functions import text as T
from foliant.functions.paging import page_pieces
from foliant.operators import chunks, dialogue_chunks, export
from foliant.plans import sql as S
from foliant.plans.clean import lit_sql, strip_sql
from foliant.plans.registry import query

_X = strip_sql("line")
_LINES = f"""ln AS (
  SELECT page_id, page_title, n, line, length(regexp_extract({_X}, '^(#{{1,6}})\\s+(.*)$', 1)) AS lvl,
    {strip_sql(f"regexp_extract({_X}, '^(#{{1,6}})\\s+(.*)$', 2)")} AS title
  FROM (SELECT page_id, page_title, unnest(string_split(content_markdown, chr(10))) AS line,
    generate_subscripts(string_split(content_markdown, chr(10)), 1) AS n FROM sectioned)),
po AS (SELECT *,
    sum(CASE WHEN lvl > 0 AND n > 1 THEN 1 ELSE 0 END) OVER w AS block_no,
    max(CASE WHEN lvl = 2 THEN n END) OVER w AS p2, max(CASE WHEN lvl = 3 THEN n END) OVER w AS p3,
    max(CASE WHEN lvl = 4 THEN n END) OVER w AS p4 FROM ln
  WINDOW w AS (PARTITION BY page_id ORDER BY n)),
bl AS (SELECT page_id, any_value(page_title) AS page_title, block_no, max(p2) AS p2, max(p3) AS p3,
    max(p4) AS p4, string_agg(line, chr(10) ORDER BY n) AS body,
    {strip_sql("coalesce(string_agg(CASE WHEN lvl = 0 THEN line END, chr(10) ORDER BY n), '')")}
      AS text FROM po GROUP BY page_id, block_no),
blocks AS (SELECT b.page_id, b.page_title, b.block_no::INTEGER AS block_no,
    a2.title AS h2, CASE WHEN b.p3 > coalesce(b.p2, 0) THEN a3.title END AS h3,
    CASE WHEN b.p4 > greatest(coalesce(b.p2, 0), coalesce(b.p3, 0)) THEN a4.title END AS h4,
    body, text
  FROM bl b LEFT JOIN ln a2 ON a2.page_id = b.page_id AND a2.n = b.p2
  LEFT JOIN ln a3 ON a3.page_id = b.page_id AND a3.n = b.p3
  LEFT JOIN ln a4 ON a4.page_id = b.page_id AND a4.n = b.p4)"""
BLOCKS = f"{S.SECTIONED}, {_LINES}"


@query("heading_blocks", f"""
WITH {BLOCKS} SELECT page_id, block_no, h2, h3, h4, body FROM blocks""")
def heading_blocks(spark, sf):
    pages = staging.sectioned_pages(spark, sf).select("page_id", "content_markdown")
    blocks = chunks.heading_blocks(pages, "content_markdown")
    return blocks.select("page_id", "block_no", *[
        F.get("h", F.lit(i - 1)).alias(f"h{i}") for i in (2, 3, 4)], "body")


_PREFIX = """'Page: ' || page_title || CASE WHEN concat_ws(' > ', h2, h3, h4) <> '' THEN
  ' | Section: ' || concat_ws(' > ', h2, h3, h4) ELSE '' END || ' - '"""


@query("context_prefix", f"""
WITH {BLOCKS} SELECT page_id, block_no, concat_ws(' > ', h2, h3, h4) AS section,
  {_PREFIX} || text AS content FROM blocks WHERE text <> ''""")
def context_prefix(spark, sf):
    blocks = chunks.page_blocks(staging.sectioned_pages(spark, sf))
    return blocks.select("page_id", "block_no", "section", F.concat(chunks.context_prefix(
        F.col("page_title"), F.col("section")), F.col("body")).alias("content"))


@query("section_names", f"""
WITH {BLOCKS}, c AS (SELECT {_PREFIX} || text AS content FROM blocks WHERE text <> '')
SELECT DISTINCT lower(trim(x)) AS section_name FROM (
  SELECT unnest(regexp_extract_all(content, 'Section:\\s*([^\\n\\-|]+)', 1)) AS x FROM c)
WHERE trim(x) <> ''""")
def section_names(spark, sf):
    found = F.regexp_extract_all("content", F.lit(r"Section:\s*([^\n\-|]+)"), F.lit(1))
    names = F.transform(found, lambda x: F.lower(F.trim(x)))
    return context_prefix(spark, sf).select(
        F.explode(F.array_distinct(names)).alias("section_name")).filter(
        "section_name <> ''").distinct()


@query("section_chunks", f"""
WITH {BLOCKS}
SELECT page_id, block_no AS chunk_index, {_PREFIX} || text AS content_markdown,
  page_title AS meta_title, nullif(concat_ws(' > ', h2, h3, h4), '') AS meta_section
FROM blocks WHERE text <> ''""")
def section_chunks(spark, sf):
    """Stored section records turned into chunks with their metadata."""
    blocks = chunks.page_blocks(staging.sectioned_pages(spark, sf))
    sections = blocks.withColumnRenamed("block_no", "chunk_index")
    made = chunks.chunks_from_sections(sections)
    return made.select(
        "page_id", "chunk_index", "content_markdown",
        F.try_element_at("metadata", F.lit("page_title")).alias("meta_title"),
        F.try_element_at("metadata", F.lit("section")).alias("meta_section"))


@query("metadata_filter", f"""
WITH {BLOCKS} SELECT page_id, block_no FROM blocks WHERE text <> '' AND h3 IS NOT NULL
  AND h4 LIKE '%er%'""")
def metadata_filter(spark, sf):
    """Chunks below a third-level heading whose fourth-level heading holds a given word."""
    blocks = chunks.page_blocks(staging.sectioned_pages(spark, sf))
    meta = T.metadata_map({f"Header {i + 1}": F.get("heads", F.lit(i)) for i in range(6)})
    return blocks.withColumn("metadata", meta).filter(
        F.contains(F.try_element_at("metadata", F.lit("Header 4")), F.lit("er"))
        & F.map_contains_key("metadata", F.lit("Header 3"))).select("page_id", "block_no")


_HARD = """SELECT doc_id AS page_id, (i / 2250)::INTEGER AS piece_no, substr(text, i::INTEGER + 1, 2500) AS piece
FROM (SELECT doc_id, text, unnest(range(0, length(text), 2250)) AS i FROM documents)"""


@query("hard_split", _HARD)
def hard_split(spark, sf):
    docs = staging.table(spark, sf, "documents")
    return docs.select(F.col("doc_id").alias("page_id"), F.posexplode(
        chunks.hard_pieces(F.col("text"), 2500, 250)).alias("piece_no", "piece"))


@query("recursive_chunks")
def recursive_chunks(spark, sf):
    return chunks.chunk_pages(staging.sectioned_pages(spark, sf)).select(
        "page_id", "chunk_index", "section", "content_markdown")


@query("section_records")
def section_records(spark, sf):
    return chunks.section_records(chunks.chunk_pages(staging.sectioned_pages(spark, sf)))


_HEAD23 = r"^(#{2,3})\s+(.+?)\s*$"
MERGED = f"""{S.SECTIONED}, l8 AS (
  SELECT page_id, page_title, n, line, regexp_matches({_X}, {lit_sql(_HEAD23)}) AS head,
    {strip_sql(f"regexp_extract({_X}, {lit_sql(_HEAD23)}, 2)")} AS title
  FROM (SELECT page_id, page_title, unnest(string_split(content_markdown, chr(10))) AS line,
    generate_subscripts(string_split(content_markdown, chr(10)), 1) AS n FROM sectioned)),
s8 AS (SELECT *, sum(head::INTEGER) OVER (PARTITION BY page_id ORDER BY n) AS sec FROM l8),
b8 AS (SELECT page_id, sec, any_value(page_title) AS page_title,
    coalesce(max(CASE WHEN head THEN title END), 'Introduction') AS title,
    trim(regexp_replace(coalesce(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY n), ''),
      '\\s+', ' ', 'g')) AS body FROM s8 GROUP BY page_id, sec),
g8 AS (SELECT *, sum((length(body) >= 50)::INTEGER) OVER (PARTITION BY page_id ORDER BY sec) AS g
  FROM b8 WHERE body <> ''),
merged AS (SELECT page_id, any_value(page_title) AS page_title, (g - 1)::INTEGER AS section_no,
  arg_min(title, sec) AS section_title, string_agg(body, ' ' ORDER BY sec) AS content
  FROM g8 WHERE g > 0 GROUP BY page_id, g)"""


@query("merge_up_chunks", f"""
WITH {MERGED} SELECT page_id, section_no, section_title, content FROM merged""")
def merge_up_chunks(spark, sf):
    pages = staging.sectioned_pages(spark, sf).select("page_id", "content_markdown")
    return chunks.merged_sections(pages, "content_markdown")


@query("chunk_validation", f"""
WITH {MERGED}
SELECT page_id, section_no, CASE WHEN page_id % 13 = 4 THEN 'source_url'
  WHEN trim(page_title) = '' THEN 'page_title' WHEN trim(section_title) = '' THEN 'section_title'
  WHEN length({strip_sql('content')}) < 400 THEN 'content' END AS reject_reason FROM merged""")
def chunk_validation(spark, sf):
    pages = staging.sectioned_pages(spark, sf).select("page_id", "page_title", "content_markdown")
    url = F.when(F.col("page_id") % 13 == 4, F.lit("ftp://x")).otherwise(F.concat(
        F.lit("https://example.org/p/"), F.col("page_id").cast("string")))
    sections = chunks.merged_sections(pages, "content_markdown").withColumn("source_url", url)
    return chunks.validate(sections, min_chars=400).select("page_id", "section_no", "reject_reason")


def spoken_lines(spark, sf):
    lines = staging.dialogue_lines(spark, sf).withColumn("speaker", F.initcap("speaker"))
    return dialogue_chunks.render_lines(lines)


@query("dialogue_chunks")
def dialogue_chunk_rows(spark, sf):
    return dialogue_chunks.dialogue_chunks(spoken_lines(spark, sf)).select(
        "page_id", "chunk_index", "content_markdown", F.array_join("speakers", ", ").alias("speakers"))


@query("chunk_routing")
def chunk_routing(spark, sf):
    """Every page through its own chunk mode: dialogue lines, stored sections, or split."""
    said = dialogue_chunk_rows(spark, sf).select(
        F.lit("dialogue").alias("mode"), "page_id", F.col("chunk_index").cast("int"),
        "content_markdown")
    pages = staging.sectioned_pages(spark, sf)
    stored = F.col("bucket_id").isin("src0", "src1", "src2", "src3", "src4")
    blocks = chunks.page_blocks(pages.filter(stored)).withColumnRenamed("block_no", "chunk_index")
    ready = chunks.chunks_from_sections(blocks).select(
        F.lit("sections").alias("mode"), "page_id", "chunk_index", "content_markdown")
    split = chunks.chunk_pages(pages.filter(~stored)).select(
        F.lit("split").alias("mode"), "page_id", "chunk_index", "content_markdown")
    return said.unionByName(ready).unionByName(split)


VOCAB = """vocab AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-zà-öø-ÿ]+')) AS word
  FROM documents)"""


def vocabulary_table(spark, sf, lang=None):
    """Distinct lower-case words of the archive; folded map-side before the shuffle."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-zà-öø-ÿ]+)"), F.lit(1))
    docs = staging.table(spark, sf, "documents")
    if lang:
        docs = docs.filter(F.col("lang") == lang)
    return docs.select(F.explode(F.array_distinct(words)).alias("word")).distinct()


@query("vocabulary", f"WITH {VOCAB} SELECT word FROM vocab")
def vocabulary(spark, sf):
    return vocabulary_table(spark, sf)


_BLOCK = f"""'### ' || page_title || '  _(category: ' || bucket_id || ')_' || chr(10) ||
  '_canon_status: ' || canon_status || '_' || chr(10) || chr(10) ||
  CASE WHEN {strip_sql('content_markdown')} <> '' THEN {strip_sql('content_markdown')} || chr(10)
       ELSE '' END || chr(10) || '---' || chr(10)"""


@query("export_single", f"""
WITH {S.PAGES_MD}
SELECT bucket_id, page_id, {_BLOCK} AS block
FROM pages_md WHERE lang <> 'de'""")
def export_single(spark, sf):
    """Page blocks of the merged document, in bucket and title order."""
    pages = staging.pages_md(spark, sf).filter("lang <> 'de'")
    return export.rendered(pages).orderBy("bucket_id", "page_title", "page_id").select(
        "bucket_id", "page_id", "block")


# Parts by plain recursion: a page joins the open part unless that would exceed the budget.
_PARTS = f"""
WITH RECURSIVE {S.PAGES_MD}, blocks AS (
  SELECT bucket_id, page_id, {strip_sql(_BLOCK)} AS block FROM pages_md),
counted AS MATERIALIZED (
  SELECT bucket_id, page_id, len(regexp_split_to_array(block, '\\s+'))::BIGINT AS words,
    row_number() OVER (PARTITION BY bucket_id ORDER BY page_id) AS n FROM blocks),
parts AS (
  SELECT bucket_id, page_id, words, n, 0::BIGINT AS group_no, words AS filled
  FROM counted WHERE n = 1
  UNION ALL SELECT c.bucket_id, c.page_id, c.words, c.n,
    CASE WHEN filled + c.words > 5000 THEN group_no + 1 ELSE group_no END,
    CASE WHEN filled + c.words > 5000 THEN c.words ELSE filled + c.words END
  FROM parts p JOIN counted c ON c.bucket_id = p.bucket_id AND c.n = p.n + 1)"""


@query("export_parts", f"{_PARTS} SELECT bucket_id, page_id, words, group_no FROM parts")
def export_parts(spark, sf):
    return export.export_parts(staging.pages_md(spark, sf), 5000)


@query("export_manifest", f"""{_PARTS}, sized AS (
  SELECT bucket_id, group_no, count(*) AS pages, sum(words)::BIGINT AS words,
    count(*) OVER (PARTITION BY bucket_id) AS many,
    replace(replace(bucket_id, ' ', '_'), '/', '-') AS slug
  FROM parts GROUP BY bucket_id, group_no)
SELECT bucket_id, group_no, pages, words,
  slug || CASE WHEN many > 1 THEN '_part' || (group_no + 1) ELSE '' END || '.md' AS file_name,
  bucket_id || CASE WHEN many > 1 THEN ' (part ' || (group_no + 1) || '/' || many || ')' ELSE '' END
    AS label,
  CASE WHEN words > 6000 THEN 'OVERSIZE' WHEN words > 5000 THEN 'LARGE' ELSE '' END AS flag
FROM sized""")
def export_manifest(spark, sf):
    parts = export.export_parts(staging.pages_md(spark, sf), 5000)
    return export.part_manifest(parts, 5000, 6000)


@query("megafile_parts", f"""
WITH {S.PAGES_MD}
SELECT bucket_id, page_title, page_id, ((row_number() OVER (PARTITION BY bucket_id
  ORDER BY page_title, page_id) - 1) // 25)::BIGINT AS group_no FROM pages_md""")
def megafile_parts(spark, sf):
    return export.megafile_parts(staging.pages_plain(spark, sf), 25)


@query("megafiles", f"""
WITH {S.PAGES_MD}, p AS (SELECT *, ((row_number() OVER (PARTITION BY bucket_id
  ORDER BY page_title, page_id) - 1) // 25)::BIGINT AS group_no FROM pages_md)
SELECT bucket_id, group_no, count(*) AS total_pages, min(page_title) AS first_title,
  max(page_title) AS last_title FROM p GROUP BY bucket_id, group_no""")
def megafiles(spark, sf):
    """Bucket documents built as JSON and read back, as the reader of the files sees them."""
    from foliant.schemas import MEGAFILE
    pages = staging.pages_md(spark, sf)
    docs = export.megafile_documents(
        pages, export.megafile_parts(pages, 25), "2024-01-01T00:00:00Z")
    read = docs.withColumn("d", F.from_json("document", MEGAFILE))
    return read.select(
        "bucket_id", "group_no", F.col("d.metadata.total_pages").alias("total_pages"),
        F.col("d.pages")[0]["page_title"].alias("first_title"),
        F.element_at("d.pages", -1)["page_title"].alias("last_title"))


@query("output_entries", f"""
WITH {S.PAGES_MD}
SELECT page_id, '{{"page_title":' || to_json(page_title) || ',"category":"' || bucket_id ||
  '","last_updated":"2024-05-06","canon_status":"' || canon_status || '"' ||
  CASE WHEN page_id > 10 THEN ',"_pageid":' || page_id ELSE '' END || ',"lang":"' || lang || '"}}' AS entry
FROM pages_md""")
def output_entries(spark, sf):
    pages = staging.pages_md(spark, sf)
    return export.output_entry(pages.select(
        "page_id", "page_title", F.col("bucket_id").alias("category"), "canon_status", "lang",
        F.lit("2024-05-06T07:08:09Z").alias("last_updated"),
        F.when(F.col("page_id") > 10, F.col("page_id")).alias("stored_id")))


@query("message_pages")
def message_pages(spark, sf):
    """Texts cut into pages of at most 2000 characters at word boundaries."""
    docs = staging.spread(staging.table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select(F.col("doc_id").alias("page_id"), F.posexplode(
        page_pieces("text")).alias("piece_no", "piece"))
