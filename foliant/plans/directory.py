"""Directories, members, aliases and name functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant import staging
from foliant.functions import classify as C
from foliant.functions import text as T
from foliant.operators import directory as D
from foliant.plans import sql as S
from foliant.plans.chunk import VOCAB, vocabulary_table
from foliant.plans.registry import query


@query("dictionary_resolve", """
SELECT p.p_partkey, coalesce(d.text, p.p_brand) AS text FROM part p
LEFT JOIN (SELECT p_brand AS key, min(p_name) AS text FROM part WHERE p_size > 45 GROUP BY 1) d
  ON p.p_brand = d.key""")
def dictionary_resolve(spark, sf):
    part = staging.table(spark, sf, "part")
    words = part.filter("p_size > 45").groupBy(F.col("p_brand").alias("key")).agg(
        F.min("p_name").alias("text"))
    return D.resolve_keys(part.select("p_partkey", "p_brand"), "p_brand", words).select(
        "p_partkey", "text")


@query("media_lookup", """
WITH names AS (SELECT lower(p_name) AS k, arg_min(p_partkey, p_partkey) AS e FROM part GROUP BY 1)
SELECT p.p_partkey AS page_id, n.e AS entity_id,
  regexp_replace(p2.p_type || '.png__00_' || p2.p_brand, '[^A-Za-z0-9_.+-]', '_', 'g') AS file_name
FROM part p JOIN names n ON lower(p.p_name) = n.k JOIN part p2 ON p2.p_partkey = n.e
WHERE p2.p_size > 15""")
def media_lookup(spark, sf):
    part = staging.table(spark, sf, "part")
    titles = part.select(F.col("p_partkey").alias("page_id"), F.concat(
        F.lit(" "), F.upper("p_name")).alias("page_title"))
    names = part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("entity_id"),
                        F.col("p_partkey").alias("position"))
    textures = part.filter("p_size > 15").select(
        F.col("p_partkey").alias("entity_id"),
        F.concat(F.lit("/a/"), "p_type", F.lit(".png!00_"), "p_brand").alias("texture"))
    return D.media_lookup(titles, names, textures).select("page_id", "entity_id", "file_name")


@query("bucket_media", """
SELECT p_brand AS bucket_id, arg_min(p_name, p_partkey) AS file_name FROM part WHERE p_size > 15
GROUP BY p_brand""")
def bucket_media(spark, sf):
    rows = staging.table(spark, sf, "part").filter("p_size > 15").select(
        F.col("p_brand").alias("bucket_id"), F.col("p_name").alias("file_name"), "p_partkey")
    return D.first_per_bucket(rows, "bucket_id", "file_name", "p_partkey")


_STOP = "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in C.STOPWORDS) + ")"


@query("member_resolution", f"""
WITH names AS (SELECT DISTINCT translate(trim(lower(w)), '310457', 'eloast') AS name FROM (
  SELECT split_part(text, ' ', 1) AS w FROM documents) WHERE trim(w) <> ''),
toks AS (SELECT DISTINCT conv_id * 4294967296 + turn AS id, unnest(regexp_extract_all(lower(text),
  '[a-zà-ÿ][0-9a-z_à-ÿ]*')) AS token FROM conversations),
t AS (SELECT id, token, translate(token, '310457', 'eloast') AS f FROM toks WHERE length(token) >= 3),
pre AS (SELECT f, max(CASE WHEN name = f THEN 1 ELSE 0 END) = 1 AS exact FROM (
  SELECT name, substr(name, 1, unnest(range(3, greatest(length(name), 3) + 1))::INTEGER) AS f FROM names)
  GROUP BY f),
h AS (SELECT id, token, exact FROM t JOIN pre USING (f) WHERE exact OR token NOT IN {_STOP}),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY NOT exact,
  CASE WHEN exact THEN 0 ELSE -length(token) END, token) AS rn FROM h)
SELECT id, token, exact FROM r WHERE rn = 1""")
def member_resolution(spark, sf):
    msgs = staging.table(spark, sf, "conversations").select(
        (F.col("conv_id") * staging.ID_ROOM + F.col("turn")).alias("id"), "text")
    names = staging.table(spark, sf, "documents").select(
        F.split_part("text", F.lit(" "), F.lit(1)).alias("name"))
    return D.resolve_members(msgs, names, C.STOPWORDS, "id")


ROLES = (("purchase", "Command"), ("signup", "Officer"), ("error", "Member"))


@query("accreditation", """
WITH m AS (SELECT DISTINCT user_id FROM events),
r AS (SELECT user_id, min(CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'error' THEN 2 END) AS k,
  bool_or(event_type = 'signup') AS founder FROM events WHERE value > 90 GROUP BY user_id)
SELECT m.user_id, CASE k WHEN 0 THEN 'Command' WHEN 1 THEN 'Officer' WHEN 2 THEN 'Member' ELSE 'Guest' END AS status,
  coalesce(founder, false) AS founder FROM m LEFT JOIN r ON m.user_id = r.user_id""")
def accreditation(spark, sf):
    ev = staging.table(spark, sf, "events")
    owned = ev.filter("value > 90").select("user_id", F.col("event_type").alias("role")).distinct()
    return D.accreditation(ev.select("user_id").distinct(), owned, ROLES, "Guest", "signup")


@query("role_matching", """
SELECT c.name, r.role_id FROM (SELECT 'Nátion_' || n_nationkey || ' ' AS name FROM nation
  UNION ALL SELECT 'ghost ' || r_name FROM region) c
LEFT JOIN (SELECT 'nation_' || n_nationkey AS f, n_nationkey AS role_id FROM nation WHERE n_nationkey > 4) r
  ON translate(lower(trim(c.name)), 'á', 'a') = r.f""")
def role_matching(spark, sf):
    nation = staging.table(spark, sf, "nation")
    wanted = nation.select(F.concat(F.lit("Nátion_"), F.col("n_nationkey").cast("string"),
                                    F.lit(" ")).alias("name"))
    ghosts = staging.table(spark, sf, "region").select(
        F.concat(F.lit("ghost "), "r_name").alias("name"))
    present = nation.filter("n_nationkey > 4").select(
        F.upper("n_name").alias("name"), F.col("n_nationkey").alias("role_id"))
    return D.match_roles(wanted.unionByName(ghosts), present)


@query("context_subjects", """
WITH c AS (SELECT DISTINCT 'Chat ' || p_name || ', ' || p_type || ' (' || p_size || ')' AS context FROM part),
t AS (SELECT unnest(string_split(substr(context, 6), ',')) AS s FROM c WHERE NOT contains(lower(context), 'promo'))
SELECT DISTINCT lower(array_to_string(regexp_extract_all(s, '[A-Za-zÀ-ÖØ-öø-ÿ]+'), ' ')) AS subject FROM t""")
def context_subjects(spark, sf):
    part = staging.table(spark, sf, "part")
    contexts = part.select(F.concat(
        F.lit("Chat "), "p_name", F.lit(", "), "p_type", F.lit(" ("), F.col("p_size").cast("string"),
        F.lit(")")).alias("context"))
    return D.context_subjects(contexts, "chat ", ("promo",))


_ERAS = ("ASIA", "EUROPE", "AFRICA")


@query("grouped_listing", """
SELECT n_name AS key, r_name AS era, CASE r_name WHEN 'ASIA' THEN 0 WHEN 'EUROPE' THEN 1 WHEN 'AFRICA' THEN 2
  ELSE 3 END AS group_rank FROM nation JOIN region ON n_regionkey = r_regionkey""")
def grouped_listing(spark, sf):
    nation = staging.table(spark, sf, "nation")
    region = staging.table(spark, sf, "region")
    rows = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_name").alias("key"), F.col("r_name").alias("era"))
    return D.grouped_listing(rows, "era", "key", _ERAS)


@query("cast_fallback", f"""
WITH {S.PAGES_MD}, s AS (SELECT DISTINCT unnest(string_split(lower(page_title), ' ')) AS name FROM pages_md),
d AS (SELECT DISTINCT lower(split_part(text, ' ', 1)) AS name FROM benchmark)
SELECT name FROM s WHERE name IN (SELECT name FROM d)""")
def cast_fallback(spark, sf):
    sections = staging.pages_plain(spark, sf).select(
        F.explode(F.split(F.lower("page_title"), " ")).alias("name"))
    known = staging.table(spark, sf, "benchmark").select(
        F.lower(F.split_part("text", F.lit(" "), F.lit(1))).alias("name"))
    previous = staging.table(spark, sf, "nation").select(F.lower("n_name").alias("name"))
    return D.page_cast(sections, known, previous)


@query("poly_text", """
SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' ' || p_type
  WHEN 2 THEN p_brand WHEN 3 THEN NULL WHEN 4 THEN p_size::VARCHAR ELSE NULL END AS name FROM part""")
def poly_text(spark, sf):
    k = F.col("p_size") % 6
    value = (
        F.when(k == 0, F.concat(F.lit('" '), "p_name", F.lit(' "')))
        .when(k == 1, F.concat(F.lit('["'), "p_name", F.lit('", null, "", "'), "p_type", F.lit('"]')))
        .when(k == 2, F.concat(F.lit('{"value": "'), "p_brand", F.lit('"}')))
        .when(k == 3, "null").when(k == 4, F.col("p_size").cast("string")).otherwise('{"x": 1}'))
    return staging.table(spark, sf, "part").select("p_partkey", D.poly_text(value).alias("name"))


@query("roster_names", """
SELECT user_id, string_agg(event_type, ', ' ORDER BY event_type) AS roles FROM (
  SELECT DISTINCT user_id, event_type FROM events WHERE event_type <> 'view') GROUP BY user_id""")
def roster_names(spark, sf):
    roles = staging.table(spark, sf, "events").groupBy("user_id").agg(
        F.array_sort(F.collect_set("event_type")).alias("roles"))
    return roles.select("user_id", F.array_join(
        D.roster_names(F.concat(F.array(F.lit(" ")), "roles"), ("view",)), ", ").alias("roles"))


_ACC = "translate({}, 'àâäáãåçèéêëẽíìîïñòóôõöùúûüýÿ', 'aaaaaaceeeeeiiiinooooouuuuyy')"
_STEM = "regexp_replace(regexp_replace(word, 's$', ''), 'e$', '')"
FORMS_SQL = f"""forms AS (SELECT word, unnest(list_distinct(list_concat(b2,
    list_transform(list_filter(b2, lambda f: ends_with(f, 'ique')), lambda f: left(f, -4) || 'ic')))) AS form
  FROM (SELECT word, list_concat(b, list_transform(b, lambda f: {_ACC.format('f')})) AS b2 FROM (
    SELECT word, [word, {_STEM}, {_STEM} || 's', {_STEM} || 'e', {_STEM} || 'es'] AS b FROM vocab)))"""


@query("lexeme_forms", f"WITH {VOCAB}, {FORMS_SQL} SELECT word, form FROM forms")
def lexeme_forms(spark, sf):
    return vocabulary_table(spark, sf).select("word", F.explode(
        T.lexeme_forms(F.col("word"))).alias("form"))


@query("query_terms", """
WITH t AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[A-Za-zÀ-ÖØ-öø-ÿ][A-Za-zÀ-ÖØ-öø-ÿ0-9_''-]*'),
  lambda x: length(x) >= 3) AS l FROM benchmark)
SELECT item_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS terms FROM t""")
def query_terms(spark, sf):
    return staging.table(spark, sf, "benchmark").select(
        "item_id", F.array_join(T.query_terms(F.col("text")), " ").alias("terms"))


@query("content_words", f"""
WITH t AS (SELECT conv_id, turn, list_filter(regexp_extract_all(text,
    '[A-Za-zÀ-ÖØ-öø-ÿ][A-Za-zÀ-ÖØ-öø-ÿ0-9_]*'), lambda x: length(x) >= 4 AND lower(x) NOT IN {_STOP}) AS l FROM conversations),
u AS (SELECT conv_id, turn, list_concat(list_filter(l, lambda x: regexp_matches(x, '^[A-ZÀ-ÖØ-Þ]')),
  list_filter(l, lambda x: NOT regexp_matches(x, '^[A-ZÀ-ÖØ-Þ]'))) AS m FROM t)
SELECT conv_id, turn, array_to_string(list_slice(list_filter(m, lambda x, i: list_position(m, x) = i), 1, 6), ' ') AS words
FROM u""")
def content_words(spark, sf):
    return staging.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.array_join(T.content_words(F.col("text"), C.STOPWORDS), " ").alias("words"))


ALIASES = (("thand", "The Hand", "thand = The Hand"), ("eitlich", "Zeitlich", "eitlich = Zeitlich"),
           ("les", "Lesse", "les = Lesse"))


def _alias_sql(col: str, pick: int, miss: str) -> str:
    arms = []
    for a in ALIASES:
        value = f"{col} || ' ({a[1]})'" if pick == 0 else f"'{a[(2, 2, 1)[pick]]}'"
        arms.append(f"WHEN contains(lower({col}), '{a[0]}') THEN {value}")
    return f"CASE {' '.join(arms)} ELSE {miss} END"


@query("alias_expansion", f"""
SELECT item_id, {_alias_sql('text', 0, 'text')} AS expanded, {_alias_sql('text', 1, "''")} AS note,
  {_alias_sql('text', 2, "''")} AS canonical FROM benchmark""")
def alias_expansion(spark, sf):
    rows = staging.table(spark, sf, "benchmark").select(
        "item_id", T.resolve_alias(F.col("text"), ALIASES).alias("a"))
    return rows.select("item_id", "a.expanded", "a.note", "a.canonical")


@query("mention_names", """
SELECT e.event_id, CASE WHEN e.user_id % 4 = 0 THEN '' ELSE 'hi ' END || 'User ' || e.user_id || ' and User ' || e.user_id AS message
FROM events e""")
def mention_names(spark, sf):
    uid = F.col("user_id").cast("string")
    lead = F.when(F.col("user_id") % 4 == 0, F.lit("")).otherwise(F.lit("hi "))
    text = F.concat(lead, F.lit("<@"), uid, F.lit("> and <@!"), uid, F.lit("> "))
    names = F.create_map(uid, F.concat(F.lit("User "), uid))
    return staging.table(spark, sf, "events").select(
        "event_id", T.replace_mentions(text, names).alias("message"))


@query("rank_labels", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Rank ' || o_custkey END AS rank FROM orders""")
def rank_labels(spark, sf):
    conv = F.when(F.col("o_orderkey") % 3 == 0, F.lit("Intro")).otherwise(
        F.concat(F.lit("Personrank "), F.col("o_custkey").cast("string"), F.lit("Convo1")))
    return staging.table(spark, sf, "orders").select("o_orderkey", T.rank_label(conv).alias("rank"))


@query("name_citations")
def name_citations(spark, sf):
    """Whether each message cites a camel-case name made of its own opening words."""
    turns = staging.table(spark, sf, "conversations")
    words = F.split(F.col("text"), " ")
    name = F.concat(F.initcap(F.get(words, F.lit(0))), F.initcap(F.coalesce(F.get(words, F.lit(1)), F.lit("X"))))
    rows = turns.select("conv_id", "turn", "text", T.name_variants(F.regexp_replace(
        name, r"[^\p{L}]", "")).alias("variants"))
    return rows.select("conv_id", "turn", F.array_join("variants", " ").alias("variants"),
                       T.cites_name(F.col("text"), F.col("variants")).alias("cited"))


@query("subject_respelling", """
SELECT doc_id AS page_id, CASE WHEN instr(lower(text), 'the') > 0 THEN
  substr(text, 1, instr(lower(text), 'the') - 1) || '<THE>' || substr(text, instr(lower(text), 'the') + 3)
  ELSE text END AS respelled FROM documents""")
def subject_respelling(spark, sf):
    return staging.table(spark, sf, "documents").select(
        F.col("doc_id").alias("page_id"),
        T.replace_first(F.col("text"), F.lit("The"), F.lit("<THE>")).alias("respelled"))
