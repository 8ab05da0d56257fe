"""Ordered derivations over dialogue lines and the message stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant import staging
from foliant.functions import classify as C
from foliant.functions import text as T
from foliant.operators import dialogue, members, ordered
from foliant.plans import sql as S
from foliant.plans.registry import query

W = "(PARTITION BY page_id ORDER BY message_order)"


@query("parent_links", f"""
WITH {S.LINES}, a AS (
  SELECT *, lag(message_order) OVER {W} AS p, lag(player_choice) OVER {W} AS pc FROM lines),
b AS (SELECT *, sum(CASE WHEN player_choice AND NOT coalesce(pc, false) THEN 1 ELSE 0 END)
        OVER {W} AS run FROM a)
SELECT page_id, message_order, player_choice,
  CASE WHEN player_choice THEN first_value(p) OVER (PARTITION BY page_id, run, player_choice
    ORDER BY message_order) ELSE p END AS parent_order
FROM b""")
def parent_links(spark, sf):
    lines = staging.dialogue_lines(spark, sf).drop("message_text", "speaker")
    return dialogue.parent_links(lines)


@query("message_positions", f"""
WITH {S.LINES} SELECT page_id, message_order, speaker,
  (row_number() OVER {W} - 1)::BIGINT AS position
FROM lines WHERE length(message_text) >= 80""")
def message_positions(spark, sf):
    lines = staging.dialogue_lines(spark, sf)
    kept = dialogue.accepted_positions(lines, F.length("message_text") >= 80)
    return kept.select("page_id", "message_order", "speaker", "position")


@query("marker_credit", f"""
WITH {S.LINES}, a AS (SELECT *, length(message_text) < 120 AS m FROM lines),
b AS (SELECT *, sum(CASE WHEN m THEN 0 ELSE 1 END) OVER {W} AS message_no FROM a),
c AS (SELECT DISTINCT page_id, message_no FROM b WHERE m AND message_no > 0)
SELECT b.page_id, b.message_order, b.message_no::BIGINT AS message_no,
       c.page_id IS NOT NULL AS credited
FROM b LEFT JOIN c ON b.page_id = c.page_id AND b.message_no = c.message_no WHERE NOT m""")
def marker_credit(spark, sf):
    lines = staging.dialogue_lines(spark, sf)
    return dialogue.credit_markers(lines, F.length("message_text") < 120).select(
        "page_id", "message_order", "message_no", "credited")


@query("speakers_in_order", f"""
WITH {S.LINES}, f AS (SELECT page_id, speaker, min(message_order) AS a FROM lines GROUP BY 1, 2)
SELECT l.page_id, (SELECT string_agg(speaker, ', ' ORDER BY a) FROM f WHERE f.page_id = l.page_id)
  AS speakers, count(*) AS line_count, count(*) FILTER (player_choice) AS choice_count
FROM lines l GROUP BY l.page_id""")
def speakers_in_order(spark, sf):
    return dialogue.speakers_in_order(staging.dialogue_lines(spark, sf))


@query("dialogue_overview", f"""
WITH {S.LINES}
SELECT page_id, count(*) AS line_count, count(DISTINCT speaker) AS n_speakers,
  min(message_order) AS first_line, max(message_order) AS last_line,
  sum(length(message_text))::BIGINT AS chars FROM lines GROUP BY page_id""")
def dialogue_overview(spark, sf):
    # Two-step distinct count: speakers are folded before the page is brought together.
    d = staging.dialogue_lines(spark, sf).groupBy("page_id", "speaker").agg(
        F.count("*").alias("n"), F.min("message_order").alias("lo"),
        F.max("message_order").alias("hi"), F.sum(F.length("message_text")).alias("c"))
    return d.groupBy("page_id").agg(
        F.sum("n").alias("line_count"), F.count("*").alias("n_speakers"),
        F.min("lo").alias("first_line"), F.max("hi").alias("last_line"),
        F.sum("c").alias("chars"))


_REF = "lower(split_part(message_text, ' ', 1))"


@query("jump_targets", f"""
WITH {S.LINES}, k AS (SELECT page_id, message_order, {_REF} AS ref_key FROM lines)
SELECT page_id, message_order, ref_key,
  min(message_order) OVER (PARTITION BY page_id, ref_key) AS first_target,
  lead(message_order) OVER (PARTITION BY page_id, ref_key ORDER BY message_order) AS next_target
FROM k""")
def jump_targets(spark, sf):
    lines = staging.dialogue_lines(spark, sf)
    key = F.lower(F.split_part("message_text", F.lit(" "), F.lit(1)))
    refs = dialogue.jump_targets(lines.withColumn("message_text", key), F.col("message_text"))
    return refs.select("page_id", "message_order", "ref_key", "first_target", "next_target")


_TERMINAL = "(length(message_text) % 7 = 0)"
GRAPH_SQL = f"""{S.LINES}, a AS (
  SELECT page_id, message_order AS pos, player_choice AS ch, {_TERMINAL} AS term FROM lines),
b AS (SELECT *, lag(pos) OVER w AS p_pos, lag(ch) OVER w AS p_ch, lag(term) OVER w AS p_term,
  max(CASE WHEN NOT ch THEN pos END) OVER (PARTITION BY page_id ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS npc,
  min(CASE WHEN NOT ch THEN pos END) OVER (PARTITION BY page_id ORDER BY pos
    ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_npc
  FROM a WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
edges AS (
  SELECT page_id, p_pos AS source, pos AS target, 'chain' AS rule FROM b
    WHERE NOT ch AND p_pos IS NOT NULL AND NOT p_ch AND NOT p_term
  UNION ALL SELECT page_id, npc, pos, 'choice' FROM b WHERE ch AND npc IS NOT NULL
  UNION ALL SELECT page_id, p_pos, pos, 'choice' FROM b
    WHERE ch AND npc IS NULL AND p_pos IS NOT NULL AND NOT p_term
  UNION ALL SELECT page_id, pos, next_npc, 'rejoin' FROM b
    WHERE ch AND next_npc IS NOT NULL AND NOT term)"""


def dialogue_edges(spark, sf):
    lines = staging.dialogue_lines(spark, sf).withColumn(
        "size", F.length("message_text")).drop("message_text")
    return dialogue.conversation_graph(lines, F.col("size") % 7 == 0)


@query("dialogue_graph", f"WITH {GRAPH_SQL} SELECT * FROM edges")
def dialogue_graph(spark, sf):
    return dialogue_edges(spark, sf)


@query("graph_roots", f"""
WITH {GRAPH_SQL}
SELECT page_id, 'root' AS source, pos AS target FROM a
WHERE pos = 0 OR NOT EXISTS (SELECT 1 FROM edges e WHERE e.page_id = a.page_id AND e.target = a.pos)
""")
def graph_roots(spark, sf):
    nodes = staging.dialogue_lines(spark, sf).select(
        "page_id", F.col("message_order").alias("node"),
        (F.col("message_order") == 0).alias("is_start"))
    return dialogue.attach_root(nodes, dialogue_edges(spark, sf))


@query("recent_messages", f"""
WITH {S.EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC)
  AS rn FROM ev)
SELECT user_id, event_id, us, event_type, rn::INTEGER AS recency FROM r WHERE rn <= 8""")
def recent_messages(spark, sf):
    ev = staging.events(spark, sf)
    return ordered.recent_n(ev, ["user_id"], [F.col("us").desc(), F.col("event_id").desc()], 8
        ).select("user_id", "event_id", "us", "event_type", "recency").orderBy("user_id", "us")


@query("last_pairs", f"""
WITH {S.LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY message_order DESC)
  AS rn FROM lines WHERE speaker <> 'system')
SELECT page_id, message_order, speaker, length(message_text) AS chars FROM r WHERE rn <= 8""")
def last_pairs(spark, sf):
    """The last four question/answer pairs of each conversation."""
    lines = staging.dialogue_lines(spark, sf).filter("speaker <> 'system'").select(
        "page_id", "message_order", "speaker",
        F.length("message_text").cast("long").alias("chars"))
    return ordered.recent_n(lines, ["page_id"], [F.col("message_order").desc()], 8).drop("recency")


@query("context_budget", f"""
WITH {S.LINES}, r AS (SELECT page_id, message_order,
  sum(length(message_text)) OVER {W} AS running, row_number() OVER {W} AS rn FROM lines)
SELECT page_id, message_order, running::BIGINT AS running FROM r WHERE running <= 1500 OR rn = 1""")
def context_budget(spark, sf):
    lines = staging.dialogue_lines(spark, sf).select(
        "page_id", "message_order", F.length("message_text").alias("size"))
    return ordered.take_budget(lines, dialogue.KEY, dialogue.ORDER, dialogue.line_slot(),
                               F.col("size"), 1500).drop("size")


@query("activity_percentile", """
WITH c AS (SELECT user_id, count(*) AS msg_count FROM events GROUP BY user_id),
s AS (SELECT *, round_even(100.0 * (rank() OVER (ORDER BY msg_count) - 1)
        / (count(*) OVER () - 1), 0)::BIGINT AS percentile FROM c)
SELECT *, CASE WHEN percentile >= 80 THEN 'Très assidu' WHEN percentile >= 60 THEN 'Assidu'
  WHEN percentile >= 40 THEN 'Modéré' WHEN percentile >= 20 THEN 'Peu assidu'
  ELSE 'Inactif' END AS label FROM s""")
def activity_percentile(spark, sf):
    return members.activity_percentile(staging.events(spark, sf))


@query("reliability_label", """
WITH j AS (SELECT user_id, count(*) FILTER (event_type IN ('view', 'click')) AS activity,
  count(*) FILTER (event_type = 'error' AND value > 60) AS insolence,
  count(*) FILTER (event_type = 'signup' AND value > 90) AS probes FROM events GROUP BY user_id)
SELECT *, CASE WHEN probes >= 2 THEN 'Compromis' WHEN insolence >= 3 THEN 'Défaillant'
  WHEN activity = 0 THEN 'Inconnu' WHEN activity < 3 THEN 'Faible'
  WHEN activity >= 10 AND insolence = 0 AND probes = 0 THEN 'Élevée'
  WHEN activity >= 5 THEN 'Moyenne' ELSE 'Inconstant' END AS reliability
FROM j WHERE activity + insolence + probes > 0""")
def reliability_label(spark, sf):
    ev = staging.events(spark, sf)
    return members.reliability(
        ev.filter("event_type IN ('view', 'click')"),
        ev.filter("event_type = 'error' AND value > 60"),
        ev.filter("event_type = 'signup' AND value > 90"))


@query("strike_levels", f"""
WITH {S.EV}, s AS (SELECT * FROM ev WHERE event_type = 'error')
SELECT user_id, event_id, us,
  count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)
    - 1 AS level,
  count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)
    - 1 AS ledger_level
FROM s""")
def strike_levels(spark, sf):
    strikes = staging.events(spark, sf).filter("event_type = 'error'").select(
        "user_id", "event_id", "us")
    return members.strike_levels(strikes, 24 * members.HOUR_US)


_SESS = f"""{S.EV}, a AS (SELECT user_id, event_id, us,
  us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS gap FROM ev),
b AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 43200000000 THEN 1 ELSE 0 END)
  OVER (PARTITION BY user_id ORDER BY us, event_id) AS no FROM a)"""


@query("inactivity_sessions", f"""
WITH {_SESS}
SELECT user_id, min(us) AS session_start, max(us) AS session_end, count(*) AS messages
FROM b GROUP BY user_id, no""")
def inactivity_sessions(spark, sf):
    ev = staging.events(spark, sf).select("user_id", "event_id", "us")
    return members.inactivity_sessions(ev, 12 * members.HOUR_US)


def questions(spark, sf):
    return staging.dialogue_lines(spark, sf).filter("player_choice").select(
        "page_id", "message_order", F.col("message_text").alias("question"))


_ANAPHORIC = C.ANAPHORIC_START
_MARKERS = " OR ".join(f"contains(lower(question), '{m}')" for m in C.ANAPHORIC_MARKERS)
_Q_SQL = f"""q AS (SELECT conv_id AS page_id, turn AS message_order, text AS question
  FROM conversations WHERE role = 'user'),
a AS (SELECT *, row_number() OVER {W} AS rn, length(trim(question)) BETWEEN 1 AND 120 AND
  ({_MARKERS} OR regexp_matches(trim(lower(question)), '{_ANAPHORIC.replace("'", "''")}')) AS ana FROM q)"""


@query("anaphora_enrich", f"""
WITH {_Q_SQL}, b AS (SELECT *, last_value(CASE WHEN NOT ana OR rn = 1 THEN question END IGNORE NULLS)
  OVER (PARTITION BY page_id ORDER BY message_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  AS prior FROM a)
SELECT page_id, message_order, ana AS anaphoric,
  CASE WHEN ana AND prior IS NOT NULL THEN prior || ' ' || question ELSE question END AS search_text
FROM b""")
def anaphora_enrich(spark, sf):
    q = questions(spark, sf).withColumn("anaphoric", C.is_anaphoric(F.lower("question")))
    return C.enrich_anaphora(q).select("page_id", "message_order", "anaphoric", "search_text")


@query("prev_questions", f"""
WITH q AS (SELECT conv_id AS page_id, turn AS message_order, text AS question,
  lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prior FROM conversations WHERE role = 'user'),
k AS (SELECT * FROM q WHERE prior IS NULL OR prior <> question)
SELECT page_id, message_order, coalesce(array_to_string(list(question) OVER (PARTITION BY page_id
  ORDER BY message_order ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ' '), '') AS history FROM k""")
def prev_questions(spark, sf):
    q = questions(spark, sf)
    q = ordered.carry(q, dialogue.KEY, dialogue.ORDER, dialogue.line_slot(),
                      {"prior": F.col("question")}, inclusive=False)
    q = q.filter("prior IS NULL OR prior <> question")
    return ordered.previous_window(
        q, dialogue.KEY, dialogue.ORDER, dialogue.line_slot(), "question", 3, "history"
    ).select("page_id", "message_order", F.array_join("history", " ").alias("history"))


@query("overlap_prefix", """
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS piece,
  generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
l AS (SELECT *, right(lag(piece) OVER (PARTITION BY doc_id ORDER BY n), 175) AS tail,
  greatest(0, 1200 - length(piece)) AS room FROM p)
SELECT doc_id AS page_id, (n - 1)::INTEGER AS piece_index,
  CASE WHEN tail IS NULL OR starts_with(piece, tail) THEN piece
       ELSE (CASE WHEN room = 0 THEN '' ELSE right(tail, room) END) || piece END AS piece FROM l""")
def overlap_prefix(spark, sf):
    from foliant.operators.chunks import overlap
    pages = staging.pages_plain(spark, sf)
    return pages.select("page_id", F.posexplode(
        overlap(T.lines(F.col("content_markdown")), 1200, 175)).alias("piece_index", "piece"))


@query("first_wins", f"""
SELECT page_id, bucket_id, title_key FROM (
  SELECT doc_id AS page_id, source AS bucket_id, lower(trim(regexp_replace({S.TITLE}, '\\s+', ' ', 'g')))
    AS title_key, row_number() OVER (PARTITION BY lower(trim(regexp_replace({S.TITLE}, '\\s+', ' ', 'g')))
    ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def first_wins(spark, sf):
    pages = staging.pages_plain(spark, sf).select(
        "page_id", "bucket_id", T.normalize_key(F.col("page_title")).alias("title_key"))
    return ordered.first_wins(pages, ["title_key"], [F.col("page_id").asc()])
