"""Retrieval channels, fusion, dossiers, grounding and the batch pipeline."""

from __future__ import annotations


from pyspark.sql import functions as F

from foliant import staging
from foliant.functions import classify as C
from foliant.functions import embedding as EMB
from foliant.functions import text as T
from foliant.operators import ground
from foliant.operators import retrieve as R
from foliant.plans import sql as S
from foliant.plans.chunk import VOCAB, vocabulary_table
from foliant.plans.clean import strip_sql
from foliant.plans.extract import structured_rows
from foliant.plans.registry import query
from foliant.session import materialize


def vectors(spark, sf):
    return staging.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").alias("kind"))


def kind_queries(spark, sf):
    """One query vector per kind: its centroid over the whole table."""
    return R.centroids(vectors(spark, sf), "kind").withColumnRenamed("kind", "query_id").withColumn(
        "query_id", F.col("query_id").cast("long"))


_D = "list_transform(embedding, lambda x: x::DOUBLE)"
COSINE = f"""em AS (SELECT vec_id, label, {_D} AS v FROM embeddings WHERE embedding IS NOT NULL),
cd AS (SELECT label, d, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM em)
  GROUP BY 1, 2),
cent AS (SELECT label AS query_id, list(m ORDER BY d) AS q FROM cd GROUP BY label),
sc AS (SELECT c.query_id::BIGINT AS query_id, e.vec_id AS chunk_id, e.label AS kind,
  round(list_cosine_similarity(e.v, c.q), 9) AS score FROM em e, cent c)"""


def _topk_sql(source: str, k: int) -> str:
    return f"""(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rnk
  FROM {source} QUALIFY rnk <= {k})"""


@query("cosine_topk", f"""
WITH {COSINE} SELECT query_id, chunk_id, round(score, 6) AS score, rnk::INTEGER AS rank FROM {_topk_sql('sc', 12)}""")
def cosine_topk(spark, sf):
    hits = R.vector_topk(vectors(spark, sf), kind_queries(spark, sf), 12)
    return hits.withColumn("score", F.round("score", 6))


@query("candidate_pool", f"""
WITH {COSINE} SELECT query_id, chunk_id, round(greatest(0, least(1, score)), 6)::DOUBLE AS cosine_score
FROM {_topk_sql('sc', 24)}""")
def candidate_pool(spark, sf):
    hits = R.vector_topk(vectors(spark, sf), kind_queries(spark, sf), R.POOL)
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    return hits.select("query_id", "chunk_id", F.round(clipped, 6).alias("cosine_score"))


@query("relevance_floor", f"""
WITH {COSINE} SELECT query_id, chunk_id, round(score, 6) AS score FROM {_topk_sql('sc', 24)}
WHERE score >= greatest(0.35, 0.3)""")
def relevance_floor(spark, sf):
    hits = R.vector_topk(vectors(spark, sf), kind_queries(spark, sf), R.POOL)
    floor = max(0.35, 0.3)  # critical and suggestion thresholds
    return hits.filter(F.col("score") >= floor).select(
        "query_id", "chunk_id", F.round("score", 6).alias("score"))


@query("kind_exclusion", """
SELECT vec_id AS chunk_id, CASE WHEN label = 3 THEN NULL ELSE label END AS kind FROM embeddings
WHERE label = 3 OR label NOT IN (1, 7)""")
def kind_exclusion(spark, sf):
    """Rows outside the excluded kinds; a null kind always stays."""
    kind = F.when(F.col("kind") != 3, F.col("kind"))
    rows = vectors(spark, sf).select("chunk_id", kind.alias("kind"))
    return rows.filter(F.col("kind").isNull() | ~F.col("kind").isin(1, 7))


@query("consumed_exclusion", f"""
WITH {COSINE} SELECT query_id, chunk_id, round(score, 6) AS score FROM {_topk_sql(
    "(SELECT * FROM sc WHERE chunk_id NOT IN (SELECT chunk_id FROM " + _topk_sql('sc', 12) + "))", 12)}""")
def consumed_exclusion(spark, sf):
    """Second part of every query: the chunks any first part used are banned."""
    corpus, queries = vectors(spark, sf), materialize(kind_queries(spark, sf))
    used = R.vector_topk(corpus, queries, 12).select("chunk_id").distinct()
    rest = corpus.join(used, "chunk_id", "left_anti")
    return R.vector_topk(rest, queries, 12).select(
        "query_id", "chunk_id", F.round("score", 6).alias("score"))


_CH = f"""{COSINE}, a AS (SELECT query_id, chunk_id, score, 'lore' AS channel FROM {_topk_sql(
    "(SELECT * FROM sc WHERE kind < 7)", 20)}),
b AS (SELECT query_id, chunk_id, score, 'structured' AS channel FROM {_topk_sql(
    "(SELECT * FROM sc WHERE kind > 4)", 20)}),
u AS (SELECT *, 'p' || chunk_id % 50 AS page_title, 'c' || chunk_id // 3 AS content FROM a
  UNION ALL SELECT *, 'p' || chunk_id % 50, 'c' || chunk_id // 3 FROM b)"""


def channel_hits(spark, sf):
    corpus, queries = vectors(spark, sf), materialize(kind_queries(spark, sf))

    def channel(name, rows):
        hits = R.vector_topk(rows, queries, 20).drop("rank")
        return hits.select(
            "query_id", "chunk_id", "score", F.lit(name).alias("channel"),
            F.concat(F.lit("p"), (F.col("chunk_id") % 50).cast("string")).alias("page_title"),
            F.concat(F.lit("c"), F.floor(F.col("chunk_id") / 3).cast("string")).alias("content"))

    return [channel("lore", corpus.filter("kind < 7")),
            channel("structured", corpus.filter("kind > 4"))]


@query("merged_topk", f"""
WITH {_CH}, d AS (SELECT *, row_number() OVER (PARTITION BY query_id, page_title, content
  ORDER BY score DESC, chunk_id) AS r FROM (SELECT DISTINCT query_id, chunk_id, score, page_title, content FROM u))
SELECT query_id, chunk_id, page_title, content, round(score, 6) AS score FROM {_topk_sql(
    "(SELECT * FROM d WHERE r = 1)", 6)}""")
def merged_topk(spark, sf):
    return R.merge_channels(channel_hits(spark, sf), 6).select(
        "query_id", "chunk_id", "page_title", "content", F.round("score", 6).alias("score"))


@query("ordered_dedup", f"""
WITH {_CH}, d AS (SELECT *, row_number() OVER (PARTITION BY query_id, page_title, content
  ORDER BY CASE channel WHEN 'structured' THEN 0 ELSE 1 END, score DESC, chunk_id) AS r FROM u)
SELECT query_id, chunk_id, channel, page_title, content FROM d WHERE r = 1""")
def ordered_dedup(spark, sf):
    """Structured hits first: the first occurrence of a passage wins whatever its score."""
    lore, structured = channel_hits(spark, sf)
    order = [F.when(F.col("channel") == "structured", 0).otherwise(1).asc(),
             F.col("score").desc(), F.col("chunk_id").asc()]
    return R.dedup_in_order(structured.unionByName(lore), order).drop("score")


@query("channel_details", """
SELECT e.event_id, e.event_type AS kind, o.o_orderpriority AS detail, p.p_name AS name FROM events e
LEFT JOIN orders o ON e.event_type = 'purchase' AND o.o_orderkey = e.event_id
LEFT JOIN part p ON e.event_type = 'view' AND p.p_partkey = e.event_id""")
def channel_details(spark, sf):
    """Rows joined to the detail table of their own kind only."""
    ev = staging.table(spark, sf, "events").select("event_id", F.col("event_type").alias("kind"))
    orders = staging.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("event_id"), F.lit("purchase").alias("kind"),
        F.col("o_orderpriority").alias("detail"))
    part = staging.table(spark, sf, "part").select(
        F.col("p_partkey").alias("event_id"), F.lit("view").alias("kind"),
        F.col("p_name").alias("name"))
    return ev.join(orders, ["event_id", "kind"], "left").join(part, ["event_id", "kind"], "left")


@query("evaluation_grid", f"""
WITH {COSINE}, t AS (SELECT * FROM {_topk_sql('sc', 12)})
SELECT query_id, count(*) FILTER (rnk <= 3 AND kind = query_id) / 3.0 AS hit_3,
  count(*) FILTER (kind = query_id) / 12.0 AS hit_12, round(max(score), 6) AS top_score,
  CASE WHEN count(*) FILTER (rnk = 1 AND kind = query_id) = 1 THEN 'compliant' ELSE 'off' END AS verdict
FROM t GROUP BY query_id""")
def evaluation_grid(spark, sf):
    """Hit rates and verdict of each query against the expected kind."""
    corpus = vectors(spark, sf)
    hits = R.vector_topk(corpus, kind_queries(spark, sf), 12).join(
        corpus.select("chunk_id", "kind"), "chunk_id")
    hit = F.col("kind") == F.col("query_id")
    return hits.groupBy("query_id").agg(
        (F.count_if(hit & (F.col("rank") <= 3)) / F.lit(3.0)).alias("hit_3"),
        (F.count_if(hit) / F.lit(12.0)).alias("hit_12"),
        F.round(F.max("score"), 6).alias("top_score"),
        F.when(F.count_if(hit & (F.col("rank") == 1)) == 1, "compliant").otherwise("off")
        .alias("verdict"))


@query("unembedded_rows", "SELECT vec_id AS chunk_id FROM embeddings WHERE label IN (2, 5)")
def unembedded_rows(spark, sf):
    """Rows without a vector (the vectors of two kinds are withheld here)."""
    rows = vectors(spark, sf).withColumn("embedding", F.when(
        ~F.col("kind").isin(2, 5), F.col("embedding")))
    return rows.filter("embedding IS NULL").select("chunk_id")


# --- text corpus with hashed term vectors ---

def passages(spark, sf):
    docs = staging.spread(staging.table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))


def embedded_passages(spark, sf):
    return passages(spark, sf).select(
        "chunk_id", EMB.hashed_terms()(F.col("content")).alias("embedding"))


def question_table(spark, sf):
    return staging.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def question_vectors(spark, sf):
    return question_table(spark, sf).select(
        "query_id", EMB.hashed_terms()(F.col("question")).alias("embedding"))


def _hash_sql(source: str, key: str, text: str, out: str) -> str:
    return f"""{out}_w AS (SELECT {key} AS id, unnest(regexp_extract_all(lower({text}), '[a-zà-öø-ÿ]+')) AS w FROM {source}),
{out} AS (SELECT id, ('0x' || substr(md5(w), 1, 7))::BIGINT % 64 AS d,
  sum(CASE WHEN ('0x' || substr(md5(w), 8, 1))::BIGINT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS x
  FROM {out}_w GROUP BY 1, 2)"""


HASHED = f"""{_hash_sql('documents', 'doc_id', 'text', 'dv')},
{_hash_sql('benchmark', 'item_id', 'text', 'qv')},
dn AS (SELECT id, sqrt(sum(x * x)) AS n FROM dv GROUP BY id HAVING sum(x * x) > 0),
qn AS (SELECT id, sqrt(sum(x * x)) AS n FROM qv GROUP BY id HAVING sum(x * x) > 0),
dots AS (SELECT qv.id AS query_id, dv.id AS chunk_id, sum(qv.x * dv.x) AS dot FROM qv JOIN dv ON qv.d = dv.d
  GROUP BY 1, 2),
hs AS (SELECT qn.id AS query_id, dn.id AS chunk_id, round(coalesce(dot, 0) / (dn.n * qn.n), 9) AS score
  FROM qn CROSS JOIN dn LEFT JOIN dots ON dots.query_id = qn.id AND dots.chunk_id = dn.id)"""


@query("embedding_backfill", f"""
WITH {_hash_sql('documents', 'doc_id', 'text', 'dv')}
SELECT d.doc_id AS chunk_id, coalesce(sum(abs(x)), 0)::DOUBLE AS l1, coalesce(sum(x * (dv.d + 1)), 0)::DOUBLE AS moment
FROM documents d LEFT JOIN dv ON dv.id = d.doc_id GROUP BY d.doc_id""")
def embedding_backfill(spark, sf):
    """Null vectors filled by the provider, checked by two moments of each vector."""
    rows = passages(spark, sf).withColumn("embedding", F.lit(None).cast("array<float>"))
    done = EMB.backfill(rows, EMB.hashed_terms())
    v = F.transform("embedding", lambda x: x.cast("double"))
    return done.select(
        "chunk_id", F.aggregate(v, F.lit(0.0), lambda a, x: a + F.abs(x)).alias("l1"),
        F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0),
                    lambda a, x: a + x).alias("moment"))


@query("question_topk", f"""
WITH {HASHED} SELECT query_id, chunk_id, round(score, 6) AS score, rnk::INTEGER AS rank FROM {_topk_sql('hs', 12)}""")
def question_topk(spark, sf):
    hits = R.vector_topk(embedded_passages(spark, sf), question_vectors(spark, sf), 12)
    return hits.withColumn("score", F.round("score", 6))


_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in C.STOPWORDS) + "]"


def _stem_sql(w: str) -> str:
    folded = f"translate({w}, '{T.ACCENTED}', '{T.PLAIN}')"
    return f"regexp_replace({folded}, '^{R.STEM}$', '\\1')"


def _stems_sql(text: str) -> str:
    return (f"list_transform(list_filter(regexp_extract_all(lower({text}), '[a-zà-öø-ÿ]+'), "
            f"lambda w: NOT list_contains({_STOP}, w)), lambda w: {_stem_sql('w')})")


LEX = f"""lq AS (SELECT item_id AS query_id, list_distinct({_stems_sql('text')}) AS req FROM benchmark),
ld AS (SELECT doc_id AS chunk_id, {_stems_sql('text')} AS st FROM documents),
lx AS (SELECT query_id, chunk_id, len(list_filter(st, lambda s: list_contains(req, s))) / len(st) AS score
  FROM lq, ld WHERE len(req) > 0 AND list_has_all(st, req))"""


@query("lexical_topk", f"""
WITH {LEX} SELECT query_id, chunk_id, round(score, 6) AS score, rnk::INTEGER AS rank FROM {_topk_sql('lx', 24)}""")
def lexical_topk(spark, sf):
    hits = R.lexical_topk(passages(spark, sf), question_table(spark, sf), C.STOPWORDS)
    return hits.withColumn("score", F.round("score", 6))


@query("hybrid_topk", f"""
WITH {HASHED}, {LEX}, v AS (SELECT * FROM {_topk_sql('hs', 24)}), x AS (SELECT * FROM {_topk_sql('lx', 24)}),
f AS (SELECT coalesce(v.query_id, x.query_id) AS query_id, coalesce(v.chunk_id, x.chunk_id) AS chunk_id,
  CASE WHEN v.score IS NOT NULL THEN greatest(0.0, least(1.0, v.score)) END AS cosine_score, x.score / (1.0 + x.score) AS ts_score
  FROM v FULL JOIN x
    ON v.query_id = x.query_id AND v.chunk_id = x.chunk_id),
g AS (SELECT *, round(coalesce(0.6 * cosine_score, 0) + coalesce(0.4 * ts_score, 0), 9) AS score FROM f)
SELECT query_id, chunk_id, round(cosine_score, 6) AS cosine_score, round(ts_score, 6) AS ts_score,
  round(score, 6) AS score, rnk::INTEGER AS rank FROM {_topk_sql('g', 12)}""")
def hybrid_topk(spark, sf):
    """Vector and lexical channels over all passages, fused per question."""
    questions = question_table(spark, sf)
    v = R.vector_topk(embedded_passages(spark, sf), question_vectors(spark, sf), R.POOL)
    x = R.lexical_topk(passages(spark, sf), questions, C.STOPWORDS)
    fused = R.fuse_channels(v, x)
    return fused.select("query_id", "chunk_id", *[
        F.round(c, 6).alias(c) for c in ("cosine_score", "ts_score", "score")], "rank")


@query("lexical_alternatives")
def lexical_alternatives(spark, sf):
    """Web-search syntax: alternatives, exclusions and quoted groups."""
    words = F.split(F.regexp_replace("question", r"[^\p{L} ]", ""), " ")
    web = F.concat(F.lit('"'), F.get(words, F.lit(0)), F.lit('" or '), F.get(words, F.lit(3)),
                   F.lit(" -"), F.get(words, F.lit(5)))
    asked = question_table(spark, sf).select("query_id", web.alias("question"))
    return R.lexical_topk(passages(spark, sf), asked, C.STOPWORDS, 12)


@query("headlines")
def headlines(spark, sf):
    """Best fragment of each lexical hit around the terms of its question."""
    hits = R.lexical_topk(passages(spark, sf), question_table(spark, sf), C.STOPWORDS)
    texts = passages(spark, sf).join(hits, "chunk_id").join(question_table(spark, sf), "query_id")
    words = F.regexp_extract_all("content", F.lit("([A-Za-zÀ-ÖØ-öø-ÿ]+)"), F.lit(1))
    return R.best_fragment(texts, words, T.query_terms(F.col("question")), "headline").select(
        "query_id", "chunk_id", "headline")


@query("ann_topk")
def ann_topk(spark, sf):
    """Approximate neighbours: vectors filed under k-means cells, by the root of their number."""
    corpus = materialize(vectors(spark, sf))
    centres = R.train_cells(corpus, R.cells_for(corpus.count()))
    filed = materialize(R.assign_cells(corpus, centres).withColumn(
        "cell", F.get("cells", F.lit(0))).drop("cells"))
    asked = materialize(kind_queries(spark, sf))
    return R.cell_topk(filed, asked, centres, 12, R.probes_for(filed, asked, centres, 12))


@query("ann_recall")
def ann_recall(spark, sf):
    """Share of the exact neighbours that the approximate search finds, per query."""
    approx = ann_topk(spark, sf).select("query_id", "chunk_id", F.lit(1).alias("found"))
    exact = R.vector_topk(vectors(spark, sf), kind_queries(spark, sf), 12)
    return exact.join(approx, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(
        F.round(F.avg(F.coalesce("found", F.lit(0))), 6).alias("recall"))


# --- dossiers over sectioned chunks ---

SUBJECT = ("thand", "anin")


def line_chunks(spark, sf):
    return staging.pages_plain(spark, sf).select("page_id", "page_title", F.posexplode(
        T.lines(F.col("content_markdown"))).alias("chunk_index", "content")).withColumn(
        "chunk_id", F.col("page_id") * staging.ID_ROOM + F.col("chunk_index"))


_DOS = f"""ch AS (SELECT doc_id AS page_id, {S.TITLE} AS page_title, n - 1 AS chunk_index, content,
  doc_id * 4294967296 + n - 1 AS chunk_id FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS content,
    generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)),
ti AS (SELECT *, CASE WHEN lower(page_title) IN ('thand', 'anin', 'thand (fr)', 'anin (fr)') THEN 0
  WHEN starts_with(lower(page_title), 'thand/') OR starts_with(lower(page_title), 'anin/') THEN 1
  WHEN contains(lower(page_title), 'thand') OR contains(lower(page_title), 'anin') THEN 2 ELSE 3 END AS tier FROM ch),
ds AS (SELECT * FROM ti WHERE tier < 3 OR contains(lower(content), 'thand') OR contains(lower(content), 'anin'))"""


@query("dossier_page", f"""
WITH {_DOS}, t AS (SELECT *, row_number() OVER (ORDER BY tier, page_id, chunk_index) AS rn FROM ds)
SELECT page_id, chunk_index::INTEGER AS chunk_index, tier, rn::INTEGER AS rn,
  (SELECT count(*) FROM ds) > 12 AS more FROM t WHERE rn <= 12""")
def dossier_page(spark, sf):
    return R.dossier(line_chunks(spark, sf), SUBJECT).select(
        "page_id", "chunk_index", "tier", "rn", "more")


@query("dossier_next_page", f"""
WITH {_DOS}, t AS (SELECT *, row_number() OVER (ORDER BY tier, page_id, chunk_index) AS rn FROM ds)
SELECT page_id, chunk_index::INTEGER AS chunk_index, tier, (rn - 12)::INTEGER AS rn,
  (SELECT count(*) FROM ds) > 24 AS more FROM t WHERE rn > 12 AND rn <= 24""")
def dossier_next_page(spark, sf):
    """Second part of a tale: what the first part used is banned."""
    chunks = line_chunks(spark, sf)
    first = R.dossier(chunks, SUBJECT)
    return R.dossier(chunks, SUBJECT, consumed=first).select(
        "page_id", "chunk_index", "tier", "rn", "more")


@query("session_parts", f"""
WITH {_DOS}, t AS (SELECT page_title, chunk_id, row_number() OVER (PARTITION BY page_title
  ORDER BY page_id, chunk_index) AS rn FROM ds)
SELECT page_title, chunk_id, ((rn - 1) // 12 + 1)::BIGINT AS part_no FROM t""")
def session_parts(spark, sf):
    """Part of the session in which each chunk of a title's dossier is used.

    Without budget cuts the growing ban list amounts to cutting the reading order into
    pages, so the parts are packed instead of anti-joined round by round.
    """
    from foliant.operators.packing import pack
    low, title = F.lower("content"), F.lower("page_title")
    hit = F.contains(title, F.lit("thand")) | F.contains(title, F.lit("anin")) | F.contains(
        low, F.lit("thand")) | F.contains(low, F.lit("anin"))
    chosen = line_chunks(spark, sf).filter(hit)
    parts = pack(chosen, ["page_title"], ["page_id", "chunk_index"], F.lit(1), R.DOSSIER_PAGE,
                 keep=["chunk_id"])
    return parts.select("page_title", "chunk_id", (F.col("group_no") + 1).alias("part_no"))


@query("structured_dossier", f"""
WITH {S.LINES}, s AS (SELECT 'line' AS kind, page_id * 4294967296 + message_order AS source_id, message_order AS conv_order,
  CASE WHEN contains(lower(message_text), 'thand') THEN 3 END AS tier FROM lines
  UNION ALL SELECT 'item', p_partkey, NULL, CASE WHEN p_name = 'small ring' THEN 0
    WHEN contains(p_name, 'ring') THEN 2 END FROM part)
SELECT kind, source_id, tier FROM s WHERE tier IS NOT NULL ORDER BY tier, conv_order NULLS LAST, kind, source_id LIMIT 40""")
def structured_dossier(spark, sf):
    """Dossier over structured rows: tiers, then conversation order with nulls last."""
    lines = staging.dialogue_lines(spark, sf).select(
        F.lit("line").alias("kind"), (F.col("page_id") * staging.ID_ROOM + F.col("message_order")).alias("source_id"),
        F.col("message_order").alias("conv_order"),
        F.when(F.contains(F.lower("message_text"), F.lit("thand")), 3).alias("tier"))
    items = staging.table(spark, sf, "part").select(
        F.lit("item").alias("kind"), F.col("p_partkey").alias("source_id"),
        F.lit(None).cast("long").alias("conv_order"),
        F.when(F.col("p_name") == "small ring", 0).when(
            F.contains("p_name", F.lit("ring")), 2).alias("tier"))
    return lines.unionByName(items).filter("tier IS NOT NULL").orderBy(
        "tier", F.col("conv_order").asc_nulls_last(), "kind", "source_id").limit(40).select(
        "kind", "source_id", "tier")


_TOK = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9''_-]{3,}'))"


@query("title_matches", f"""
WITH q AS (SELECT DISTINCT unnest({_TOK}) AS token FROM benchmark),
t AS (SELECT DISTINCT {S.TITLE} AS page_title FROM documents)
SELECT token, count(*) AS titles, min(page_title) AS first_title FROM q JOIN t
  ON contains(lower(page_title), token) GROUP BY token""")
def title_matches(spark, sf):
    """Titles that contain each word of the question set."""
    tokens = F.array_distinct(F.regexp_extract_all(
        F.lower("question"), F.lit(r"([a-z0-9'_-]{3,})"), F.lit(1)))
    asked = question_table(spark, sf).select(F.explode(tokens).alias("pattern"))
    titles = staging.pages_plain(spark, sf).select("page_title").distinct()
    found = R.contained_patterns(titles, "page_title", asked, ["page_title"])
    return found.groupBy(F.col("pattern").alias("token")).agg(
        F.count("*").alias("titles"), F.min("page_title").alias("first_title"))


@query("title_suggestion")
def title_suggestion(spark, sf):
    return R.suggest_titles(question_table(spark, sf), staging.pages_plain(spark, sf))


# --- context, entities, grounding ---

@query("context_assembly", f"""
WITH {HASHED}, h AS (SELECT * FROM {_topk_sql('hs', 6)}),
b AS (SELECT h.query_id, rnk, chunk_id, '[' || {S.TITLE} || '] ' || {strip_sql('text')} AS block
  FROM h JOIN documents ON doc_id = chunk_id),
c AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rnk) AS used FROM b)
SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rnk) AS context,
  string_agg(chunk_id::VARCHAR, ',' ORDER BY rnk) AS used_ids FROM c WHERE used <= 4500 OR rnk = 1 GROUP BY query_id""")
def context_assembly(spark, sf):
    return contexts(spark, sf, 6, 4500).select(
        "query_id", "context", F.array_join(F.transform(
            "used_ids", lambda x: x.cast("string")), ",").alias("used_ids"))


def contexts(spark, sf, k, budget):
    hits = R.vector_topk(embedded_passages(spark, sf), question_vectors(spark, sf), k)
    pages = staging.pages_plain(spark, sf).select(
        F.col("page_id").alias("chunk_id"), "page_title", F.col("content_markdown").alias("content"))
    return R.assemble_context(pages.join(hits, "chunk_id"), budget)


_ENT = f"""en AS (SELECT id, unnest(list_slice(list_filter(regexp_extract_all(s, '[0-9A-Za-z_À-ÖØ-öø-ÿ]+'),
    lambda w: regexp_matches(w, '^[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ]+$')), 2, 100000)) AS w FROM (
  SELECT id, unnest(regexp_split_to_array(regexp_replace(t, '[*_>`#\\-\\[\\](){{}}~]', ' ', 'g'), '[.!?:]\\s+')) AS s
  FROM src)),
ents AS (SELECT DISTINCT id, lower(w) AS entity FROM en)"""


@query("entity_extraction", f"""
WITH src AS (SELECT doc_id AS id, text AS t FROM documents), {_ENT} SELECT id AS page_id, entity FROM ents""")
def entity_extraction(spark, sf):
    return staging.table(spark, sf, "documents").select(
        F.col("doc_id").alias("page_id"), F.explode(ground.entities(F.col("text"))).alias("entity"))


def answers(spark, sf):
    """Answers to check: each question's own text plus the opening of the next passage."""
    ctx = contexts(spark, sf, 3, 4500)
    q = question_table(spark, sf)
    extra = F.concat("question", F.lit(" Le Grand Zorvax parle. L'Orvane attend l'orvane."))
    return q.join(ctx, "query_id").select("query_id", extra.alias("answer"), "context")


@query("grounding_check")
def grounding_check(spark, sf):
    return ground.unsupported(answers(spark, sf))


@query("archive_excuse", f"""
WITH src AS (SELECT conv_id * 4294967296 + turn AS id, text || CASE WHEN turn % 4 = 0
    THEN ' See Zq' || translate(left(md5(conv_id::VARCHAR), 6), '0123456789', 'ghijklmnop') ELSE '' END AS t
  FROM conversations), {_ENT}, {VOCAB},
forms AS (SELECT word, unnest(list_distinct(list_concat(b2, list_transform(list_filter(b2,
    lambda f: ends_with(f, 'ique')), lambda f: left(f, -4) || 'ic')))) AS form FROM (
  SELECT word, list_concat(b, list_transform(b, lambda f: translate(f, '{T.ACCENTED}', '{T.PLAIN}'))) AS b2 FROM (
    SELECT word, [word, st, st || 's', st || 'e', st || 'es'] AS b FROM (
      SELECT entity AS word, regexp_replace(regexp_replace(entity, 's$', ''), 'e$', '') AS st
      FROM (SELECT DISTINCT entity FROM ents))))),
known AS (SELECT DISTINCT f.word FROM forms f JOIN vocab v ON f.form = v.word)
SELECT id AS query_id, entity FROM ents WHERE entity NOT IN (SELECT word FROM known)""")
def archive_excuse(spark, sf):
    """Names in the messages that no spelling of the archive covers.

    Every fourth turn names someone unheard of.
    """
    stranger = F.concat(F.lit(" See Zq"), F.translate(F.left(F.md5(F.col("conv_id").cast("string")), F.lit(
        6)), "0123456789", "ghijklmnop"))
    words = staging.table(spark, sf, "conversations").withColumn("text", F.concat("text", F.when(
        F.col("turn") % 4 == 0, stranger).otherwise(F.lit("")))).select(
        (F.col("conv_id") * staging.ID_ROOM + F.col("turn")).alias("query_id"),
        F.explode(ground.entities(F.col("text"))).alias("entity"))
    return ground.absent_from_archive(words, vocabulary_table(spark, sf), "entity").select(
        "query_id", "entity")


@query("entity_guard", f"""
WITH {HASHED}, h AS (SELECT * FROM {_topk_sql('hs', 6)}),
e AS (SELECT item_id AS query_id, regexp_extract(text, '[A-Za-zÀ-ÖØ-öø-ÿ]{{5,}}') AS w FROM benchmark),
k AS (SELECT query_id, upper(left(w, 1)) || substr(w, 2) AS entity FROM e)
SELECT k.query_id, k.entity, NOT bool_or(contains(lower(text), lower(k.entity))) AS missing
FROM k JOIN h ON h.query_id = k.query_id JOIN documents ON doc_id = h.chunk_id GROUP BY 1, 2""")
def entity_guard(spark, sf):
    """Lookup questions whose entity stands in none of the kept passages."""
    bare = F.regexp_extract("question", "([A-Za-zÀ-ÖØ-öø-ÿ]{5,})", 1)
    name = F.concat(F.upper(F.substring(bare, 1, 1)), F.substring(bare, F.lit(2), F.length(bare)))
    asked = question_table(spark, sf).select("query_id", C.lookup_entity(
        F.concat(F.lit("Qui est "), name, F.lit(" ?"))).alias("entity"))
    hits = R.vector_topk(embedded_passages(spark, sf), question_vectors(spark, sf), 6)
    rows = passages(spark, sf).join(hits, "chunk_id").join(asked, "query_id")
    return ground.missing_entity(rows.filter("entity IS NOT NULL"), "entity")


@query("batch_retrieval")
def batch_retrieval(spark, sf):
    """The decision chain over a table of questions: one audit row per question."""
    from foliant.plans.directory import ALIASES
    q = question_table(spark, sf).withColumn("question", T.sanitize_query(F.col("question")))
    q = q.withColumn("rejected", C.is_probe(F.lower("question"))).withColumn(
        "a", T.resolve_alias(F.col("question"), ALIASES))
    q = materialize(q.select("query_id", "question", "rejected", F.col("a.expanded").alias("search_text"),
                             F.col("a.note").alias("note"), F.col("a.canonical").alias("canonical")))
    live = q.filter("NOT rejected")
    vecs = live.select("query_id", EMB.hashed_terms()(F.col("search_text")).alias("embedding"))
    hits = R.vector_topk(embedded_passages(spark, sf), vecs, 6)
    pages = staging.pages_plain(spark, sf).select(
        F.col("page_id").alias("chunk_id"), "page_title", F.col("content_markdown").alias("content"))
    found = pages.join(hits, "chunk_id")
    kept = found.filter(F.col("score") >= 0.45)
    context = R.assemble_context(kept, 4500)
    suggestion = R.suggest_titles(live.select("query_id", "question"), pages)
    audit = q.join(found.groupBy("query_id").agg(
        F.count("*").alias("hits"), F.round(F.max("score"), 6).alias("top_score")), "query_id", "left"
    ).join(context, "query_id", "left").join(suggestion, "query_id", "left")
    weak = F.col("context").isNull()
    proposed = F.when(weak & ~F.col("rejected"), F.when(
        F.col("note") != "", F.col("canonical")).otherwise(F.col("suggestion")))
    return audit.select(
        "query_id", "question", "search_text", "rejected", F.coalesce("hits", F.lit(0)).alias("hits"),
        "top_score", proposed.alias("suggestion"),
        (weak & proposed.isNull()).alias("bypass"),
        F.coalesce(F.length("context"), F.lit(0)).alias("context_chars"),
        F.col("context").alias("context"))


@query("structured_rebuild", """
SELECT kind, count(*) AS chunks FROM (
  SELECT 'variants' AS kind FROM part UNION ALL SELECT 'quests' FROM part UNION ALL SELECT 'records' FROM part
  UNION ALL SELECT 'updates' FROM orders UNION ALL SELECT 'announcements' FROM orders
  UNION ALL SELECT 'dialogues' FROM conversations UNION ALL SELECT 'chat_dialogues' FROM conversations)
GROUP BY kind""")
def structured_rebuild(spark, sf):
    """Structured chunks of every kind rendered and embedded, checked per kind."""
    rows = structured_rows(spark, sf).withColumn("embedding", F.lit(None).cast("array<float>"))
    done = EMB.backfill(rows, EMB.hashed_terms())
    return done.filter(F.size("embedding") == EMB.DIM).groupBy("kind").agg(
        F.count("*").alias("chunks"))


@query("section_labels", f"""
SELECT doc_id AS page_id, CASE WHEN doc_id % 2 = 0 THEN 'Stored' ELSE 'H2 > ' || lang END AS section,
  {strip_sql('text')} AS body FROM documents""")
def section_labels(spark, sf):
    """Section label of each chunk and its text without the context prefix."""
    docs = staging.table(spark, sf, "documents")
    meta = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("section"), F.lit("Stored"))).otherwise(
        F.create_map(F.lit("Header 2"), F.lit("H2"), F.lit("Header 4"), F.col("lang")))
    content = F.concat(F.lit("Page: "), "source", F.lit(" | Section: S - "), "text")
    return docs.select(F.col("doc_id").alias("page_id"), T.section_label(meta).alias("section"),
                       T.strip_context_prefix(content).alias("body"))


