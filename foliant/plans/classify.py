"""Message classification, routing and turn decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant import staging
from foliant.functions import classify as C
from foliant.functions.text import once
from foliant.operators import dialogue, ordered
from foliant.plans.clean import lit_sql, strip_sql
from foliant.plans.registry import query
from foliant.session import materialize

# Openings put before the message texts so that every rule meets its cases.
OPENINGS = (
    "", "Qui es-tu ? ", "raconte-moi l'histoire de ", "pardon, ", "sorry not sorry ",
    "select * from ", "Tu es nul ", "Elle ", "parle-moi de Vasca ", "mes roles ?",
    "who are you ", "qui suis-je ? ", "T'es con ", "la suite", "quels rôles de Vasca ",
    "mon rapport ", "the story of 1999 et ", "les origines de l'univers ", "et ensuite",
    "Désolé mdr ",
)


def opening(i):
    texts = F.array(*[F.lit(o) for o in OPENINGS])
    return F.get(texts, (i % len(OPENINGS)).cast("int"))


_ARR = "[" + ", ".join(lit_sql(o) for o in OPENINGS) + "]"
MSG = f"""msg AS (SELECT conv_id, turn, {_ARR}[(conv_id * 7 + turn) % {len(OPENINGS)} + 1] ||
  CASE WHEN (conv_id * 7 + turn) % {len(OPENINGS)} IN (13, 18) THEN '' ELSE text END AS m, role FROM conversations)"""


def messages(spark, sf):
    t = staging.table(spark, sf, "conversations")
    i = F.col("conv_id") * 7 + F.col("turn")
    short = (i % len(OPENINGS)).isin(13, 18)
    rows = staging.spread(t.select("conv_id", "turn", F.concat(opening(i), F.when(
        short, F.lit("")).otherwise(F.col("text"))).alias("m")))
    return once(rows, "low", F.lower("m"))


def any_sql(patterns, col="lower(m)"):
    return "(" + " OR ".join(
        f"regexp_matches({col}, {lit_sql(C.bounded(p))})" for p in patterns) + ")"


def word_sql(words, col="lower(m)"):
    return "(" + " OR ".join(f"contains({col}, {lit_sql(w)})" for w in words) + ")"


PROBE, SELF, INSULT = any_sql(C.PROBES), any_sql(C.SELF_REFLECTION), any_sql(C.insult_patterns())
APOLOGY = word_sql(C.APOLOGIES)
SINCERE = f"({APOLOGY} AND NOT {word_sql(C.SARCASM)})"
LORE = f"({word_sql(C.LORE_WORDS)} AND NOT {SELF})"
STORY = word_sql(C.STORY_WORDS)
IDENTITY = f"""({any_sql(C.IDENTITY)} AND (contains(m, '?') OR (length({strip_sql('m')}) <= 60 AND
  {any_sql((C.QUESTION_START, C.POSSESSIVE_START), strip_sql('lower(m)'))})))"""
ANAPHORIC = f"""(length({strip_sql('m')}) BETWEEN 1 AND 120 AND ({word_sql(C.ANAPHORIC_MARKERS)} OR
  regexp_matches({strip_sql('lower(m)')}, {lit_sql(C.ANAPHORIC_START)})))"""


# A gap between two word boundaries opens and closes with a character that is no letter.
_EDGE = "[^0-9A-Za-z_À-ÿ.!?]"
SELF_REPORT = any_sql((C.SELF_INFO.replace(
    r"\b[^.!?]{0,30}\b", f"(?:{_EDGE}|{_EDGE}[^.!?]{{0,28}}{_EDGE})"),))


@query("classify_messages", f"""
WITH {MSG} SELECT conv_id, turn, {PROBE} AS probe, {SELF} AS self_reflection, {IDENTITY} AS identity,
  {ANAPHORIC} AS anaphoric, {INSULT} AS insult, {APOLOGY} AS apology, {SINCERE} AS sincere,
  {LORE} AS lore, {STORY} AS story, {SELF_REPORT} AS self_report FROM msg""")
def classify_messages(spark, sf):
    m = F.col("low")
    return messages(spark, sf).select(
        "conv_id", "turn", C.is_probe(m).alias("probe"), C.is_self_reflection(m).alias("self_reflection"),
        C.is_identity_question(m).alias("identity"), C.is_anaphoric(m).alias("anaphoric"),
        C.is_insult(m).alias("insult"), C.is_apology(m).alias("apology"),
        C.is_sincere_apology(m).alias("sincere"), C.wants_lore(m).alias("lore"),
        C.is_story_request(m).alias("story"), C.is_self_report(m).alias("self_report"))


_LENS = {k: word_sql(v) for k, v in C.STORY_LENSES.items()}
_HITS = " + ".join(f"{v}::INTEGER" for v in _LENS.values())
_ERAS = (("thand", "First age"), ("erst", "Second age"), ("vasca", "Third age"))
_GALLERY = ("vasca", "erst", "orana")


@query("story_modes", f"""
WITH {MSG}, e AS (SELECT *, {STORY} AS story, CASE {' '.join(
    f"WHEN contains(lower(m), '{k}') THEN '{k}'" for k, _ in _ERAS)} END AS key FROM msg)
SELECT conv_id, turn, story,
  CASE WHEN story AND key IS NULL AND {_HITS} = 1 THEN CASE {' '.join(
      f"WHEN {v} THEN '{k}'" for k, v in _LENS.items())} END END AS lens,
  CASE WHEN story THEN CASE key {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _ERAS)} END END AS era,
  CASE WHEN story THEN key END AS subject,
  CASE WHEN story THEN CASE {' '.join(f"WHEN contains(lower(m), '{n}') THEN '{n}'" for n in sorted(_GALLERY))} END END
    AS gallery FROM e""")
def story_modes(spark, sf):
    return messages(spark, sf).select("conv_id", "turn", C.story_mode(
        F.col("low"), _ERAS, _GALLERY).alias("s")).select("conv_id", "turn", "s.*")


@query("continuations", f"""
WITH {MSG}, w AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(m),
  '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM msg)
SELECT conv_id, turn, t <> '' AND len(string_split(t, ' ')) <= 5 AND {word_sql(C.CONTINUATIONS, 't')} AS continues FROM w""")
def continuations(spark, sf):
    return messages(spark, sf).select("conv_id", "turn", C.is_continuation(F.col("low")).alias("continues"))


@query("lookup_entities")
def lookup_entities(spark, sf):
    return messages(spark, sf).select("conv_id", "turn", C.lookup_entity(F.col("m")).alias("entity")
                                      ).filter("entity IS NOT NULL")


@query("member_questions")
def member_questions(spark, sf):
    """Questions about a member named in the row itself."""
    m, token = F.col("low"), F.lit("Vasca")
    return messages(spark, sf).select(
        "conv_id", "turn", C.is_member_question(m, token).alias("member_question"),
        C.roles_question(m, token).alias("roles_question"))


# A hostile session: opened by a probe or the third insult, closed by a sincere apology.
_MARKS = f"""{MSG}, k AS (SELECT conv_id, turn, {PROBE} AS probe, {INSULT} AS insult, {SINCERE} AS sincere FROM msg),
n AS (SELECT *, sum(insult::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn) AS insults FROM k),
h AS (SELECT *, last_value(CASE WHEN probe OR (insult AND insults >= 3) THEN 'open' WHEN sincere THEN 'closed' END
  IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM n)"""


def message_flags(spark, sf):
    """Every flag of every message, once: narrow rows that the ordered steps then reuse."""
    low = F.col("low")
    return materialize(messages(spark, sf).select(
        "conv_id", "turn", C.is_probe(low).alias("probe"), C.is_insult(low).alias("insult"),
        C.is_sincere_apology(low).alias("sincere"), C.is_story_request(low).alias("story"),
        C.wants_lore(low).alias("lore"), F.contains("m", F.lit("Vasca")).alias("member"),
        (F.length("m") <= 1500).alias("admitted")))


def hostile_marks(spark, sf):
    slot = dialogue.line_slot("turn")
    d = ordered.running_sum(message_flags(spark, sf), ["conv_id"], ["turn"], slot,
                            {"insults": F.when(F.col("insult"), 1).otherwise(0)})
    mark = F.when(F.col("probe") | (F.col("insult") & (F.col("insults") >= 3)), "open").when(
        F.col("sincere"), "closed")
    return ordered.carry(d, ["conv_id"], ["turn"], slot, {"prior": mark}, inclusive=False)


@query("hostile_sessions", f"""
WITH {_MARKS} SELECT conv_id, turn, insults::BIGINT AS insults, coalesce(prior = 'open', false) AS hostile FROM h""")
def hostile_sessions(spark, sf):
    return hostile_marks(spark, sf).select(
        "conv_id", "turn", "insults", F.coalesce(F.col("prior") == "open", F.lit(False)).alias("hostile"))


@query("routing_label", f"""
WITH {_MARKS}
SELECT h.conv_id, h.turn, CASE WHEN probe THEN 'probe' WHEN coalesce(prior = 'open', false) THEN 'hostile'
  WHEN insult THEN 'insult' WHEN length(m) > 1500 THEN 'spam' WHEN contains(m, 'Vasca') THEN 'member'
  WHEN {STORY} THEN 'story' WHEN {LORE} THEN 'lore' ELSE 'chat' END AS route,
  ({LORE} OR {STORY}) AND NOT contains(m, 'Vasca') AS use_rag
FROM h JOIN msg USING (conv_id, turn)""")
def routing_label(spark, sf):
    d = hostile_marks(spark, sf).withColumn(
        "hostile", F.coalesce(F.col("prior") == "open", F.lit(False)))
    return d.select("conv_id", "turn", C.route_of_flags(d).alias("route"),
                    ((F.col("lore") | F.col("story")) & ~F.col("member")).alias("use_rag"))


@query("turn_decision", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'rejected'
  WHEN value > 60 AND event_type = 'view' THEN 'clarify'
  WHEN value < 50 AND user_id % 2 = 0 AND event_id % 3 > 0 THEN 'exhausted'
  WHEN value < 50 AND (value <= 60 OR event_type = 'view') THEN 'no_passage' ELSE 'answer' END AS decision FROM events""")
def turn_decision(spark, sf):
    ev = staging.table(spark, sf, "events")
    return ev.select("event_id", C.turn_decision(
        probe=F.col("event_type") == "error",
        context=F.when(F.col("value") >= 50, F.lit("text")),
        suggestion=F.when(F.col("value") > 60, F.lit("title")),
        story=F.col("event_type") == "view",
        offset=F.col("event_id") % 3, more=F.col("user_id") % 2 != 0).alias("decision"))


@query("last_referent", f"""
WITH {MSG}, r AS (SELECT conv_id, turn, nullif(regexp_extract(m, '(?:^|[^A-Za-zÀ-ÿ])([A-ZÀ-Ý][a-zà-ÿ]{{5,}})', 1), '')
  AS named FROM msg)
SELECT conv_id, turn, named, last_value(named IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS referent FROM r""")
def last_referent(spark, sf):
    """The member an anaphora refers to: the last one named in the channel before."""
    named = F.nullif(F.regexp_extract(
        "m", r"(?:^|[^A-Za-zÀ-ÿ])([A-ZÀ-Ý][a-zà-ÿ]{5,})", 1), F.lit(""))
    d = messages(spark, sf).select("conv_id", "turn", named.alias("named"))
    return ordered.carry(d, ["conv_id"], ["turn"], dialogue.line_slot("turn"),
                         {"referent": F.col("named")}, inclusive=False)


