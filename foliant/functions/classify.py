"""Message and question classifiers as flag columns.

All classifiers read lower-cased text (lower it once, not per rule); only
:func:`lookup_entity` needs the original case.  All patterns are plain data.  ``\\b`` in
them stands for a word boundary that knows accented letters; :func:`bounded` spells it out
so every engine reads it the same way.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import dialogue, ordered

_WORD = "0-9A-Za-z_À-ÿ"


def _spell(pattern: str, left: str, right: str) -> str:
    """Replace each ``\\b`` by its opening or closing form, told by what comes after it."""
    opening = re.sub(r"\\b(?=[(a-zà-ÿ{])", lambda _: left, pattern)
    return opening.replace(r"\b", right)


def bounded(pattern: str) -> str:
    """Word boundaries spelled out without look-around; for patterns whose boundaries do not
    face each other across a gap."""
    return _spell(pattern, f"(?:^|[^{_WORD}])", f"(?:[^{_WORD}]|$)")


def edged(pattern: str) -> str:
    """Word boundaries as look-around: exact everywhere and several times faster in the JVM."""
    return _spell(pattern, f"(?<![{_WORD}])", f"(?![{_WORD}])")


def any_pattern(text: Column, patterns: Sequence[str]) -> Column:
    """Whether any pattern is found.

    Patterns that open at a word boundary are joined, so the boundary is tested once per
    position and only word starts reach the alternatives; the others keep their literal
    openings and are tested one by one.
    """
    opening = [p[2:] for p in patterns if p.startswith(r"\b")]
    tests = [edged(p) for p in patterns if not p.startswith(r"\b")]
    if opening:
        tests.insert(0, f"(?<![{_WORD}])(?:{'|'.join(edged(p) for p in opening)})")
    return reduce(lambda a, b: a | b, [F.rlike(text, F.lit(t)) for t in tests])


def any_word(text: Column, words: Sequence[str]) -> Column:
    """Whether any of the words is contained in the text."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


# Hostile probes (database keywords, rights, mentions).
PROBES = (
    r"\b(select|insert|update|delete|drop|truncate|alter|create|union|exec|x[ps]_|"
    r"information_schema|pg_sleep|sleep|benchmark)\b",
    r"\b(or)\s+[\"']?1[\"']?\s*[=:]?\s*[\"']?1[\"']?", r";(\s*--|\s*#)", r"'\s*--",
    r"\bset\s+[a-z_]+\s*=?",
    r"\b(is_admin|manage_server|manage_users|can_manage_|discord_id|permissions|"
    r"autorisations?)\b",
    r"(privilege\s+escalat|elevation[s]?\s+of\s+privileg)",
    r"\b(ban|kick|unban|expel|give.{0,20}role|gives?.{0,20}r[ôo]les|self-admin|administer)\b",
    r"<@!?\d+>",
)

# Questions about the assistant itself or about who the speaker is to it.
SELF_REFLECTION = (
    r"qui\s+es[- ]tu\b", r"\bes[- ]tu qui\b", r"\bt['’]es qui\b", r"qu['’]est[- ]ce que tu es\b",
    r"c['’]est quoi (toi|que tu es|tu es)\b", r"\btu es quoi\b", r"parle[- ]moi de toi\b",
    r"raconte[- ]toi\b", r"dis[- ]moi qui tu es\b",
    r"es[- ]tu (réel|réelle|une ia|un bot|un algorithme|sentient)\b",
    r"tu es (réel|réelle|une ia|un bot|sentient)\b",
    r"\b(ton|votre) (créateur|createur|ma[iî]tre)\b",
    r"qui t['’]a (créé|cree|créée|fait|construit)\b", r"qui suis[- ]je\b", r"que suis[- ]je\b",
    r"\bje suis qui\b", r"\btu me connais\b", r"me connais[- ]tu\b", r"\btu sais qui je suis\b",
    r"te souviens[- ]tu de moi\b", r"tu te souviens de moi\b", r"who are you\b",
    r"who('|’)?re you\b", r"what are you\b", r"\bwho am i\b", r"\bdo you know me\b",
    r"\byou know who i am\b", r"\bwho is your creator\b", r"\bwho created you\b",
    r"\byour creator\b", r"\bare you (real|sentient|an ai|a bot)\b",
)

# Questions about the speaker's own identity or rank.
IDENTITY = (
    r"qui suis[- ]je\b", r"\bqui je suis\b", r"\bje suis qui\b", r"que suis[- ]je\b",
    r"qu['’]est[- ]ce que je suis\b", r"qui suis[- ]je pour toi\b", r"\bje suis qui pour toi\b",
    r"\b(m[eo]n|m[eo]s)\s+r[ôo]les?\b", r"\bmon(s)? (rang|grade|statut|position)\b",
    r"(quelle est ma place|o[uù] est ma place|ma place dans la hi['é]rarchie)\b",
)
QUESTION_START = (r"^(qui|que|quel|quelle|quels|quelles|o[uù]|comment|pourquoi|est[- ]ce|"
                  r"qu['’]est[- ]ce)\b")
POSSESSIVE_START = r"^(mes?|ma|mon)\s"
IDENTITY_MAX_CHARS = 60

# Openings and markers of a question that leans on the one before it.
ANAPHORIC_OPENING = (
    r"^(et\s+|d'ailleurs\s+)?(cette\b|cet\b|cette histoire\b|cette chose\b|ce sujet\b|"
    r"celui[- ]ci|celui[- ]là|celles?[- ]ci|celles?[- ]là|il\b|elle\b|ils\b|elles\b|ça\b|cela\b)")
ANAPHORIC_START = bounded(ANAPHORIC_OPENING)
ANAPHORIC_MARKERS = (
    "juste avant", "cette histoire", "cette chose", "ce sujet", "parlé de", "dit juste",
    "comme je disais", "comme tu disais",
)
ANAPHORIC_MAX_CHARS = 120

# Insults aimed at the assistant.  {bot} is the list of names it goes by.
INSULTS = (
    r"\bavale( et dis merci)?\b", r"\b(ferme[- ]?la?|ta gueule|tais[- ]toi|la ferme|ta bouche)\b",
    r"\bva (te faire (foutre|voir|cuire|coucher)|te cacher)\b",
    r"\b(casse[- ]toi|d[ée]gage|fous le camp|d[ée]merde[- ]toi|d[ée]brouille[- ]toi)\b",
    r"t[' ]es (une? )?(nul(le)?|c[oô]n(ne)?|idiot(e)?|d[ée]bile|merde|rat[ée]|pitoyable|trash|"
    r"cringe|canc[eé]reux?)\b",
    r"\btu (es|serais|restes) (une? )?(nul(le)?|c[oô]n(ne)?|idiot(e)?|d[ée]bile|merde|rat[ée]|"
    r"pitoyable|bon(ne)? à rien)\b",
    r"\btu (ne sers?( à)? |ne serviras( à)? |es bon(ne)? à )?rien\b", r"\btu (nous)? fais chier\b",
    r"\btu (nous )?(saoules|so[ûu]les)\b", r"\btu (me |nous )?(fais|fait) chier\b",
    r"\b(fais|fait)(-moi| moi)? chier\b", r"\b(fais|fait) chi[éée]\b",
    r"\bt[' ]es (chiant|chiante)\b", r"\btu (me )?(saoules?|so[ûu]les?)\b",
    r"esp[èe]ce de (c[oô]n|connard|cr[eé]tin|d[ée]bile|abruti|imb[cé]cile|idiot|rat[ée])\b",
    r"\b(connard|connasse|encul[ée]|trou[ -]du[ -]cul|branleur|abruti|gros(se)? c[oô]n(ne)?|"
    r"pauvre (c[oô]n|type|merde)|grosse merde|rabat[- ]joie)\b",
    r"sale (bot|machine|algo|robot{names}|tas de ferraille|merde)\b",
    r"\b(bot|ia|algo|robot|oracle|programme{names}) (est |semble |para[îi]t )?(de merde|[ée]claté(e)?|inutile|naze|pourri(e)?|"
    r"[àa] chier|claqué(e)? au sol)\b",
    r"\b(mauvais|pire) (bot|ia|algo|robot|oracle{names})\b", r"\b(tg|ftg|ntm|fdp|kys|gtfo)\b",
    r"\b(shut up|shut the (fuck |hell )?up|stfu)\b",
    r"\b(fuck you|screw you|piss off|get lost|buzz off|fuck off)\b", r"\byou (suck|stink|blow)\b",
    r"\byou[’' ]re (a )?(useless|pathetic|lame|dumb|stupid|a joke|trash|garbage|cringe|"
    r"cancer)\b",
    r"\b(moron|dumbass|jackass)\b",
)

# Apologies, and the words that turn one into sarcasm.
APOLOGIES = (
    "pardon", "excuse", "excusez-moi", "désolé", "desole", "désoléé", "sorry", "mea culpa",
    "j'ai eu tort", "j'avais tort", "j'admets ma faute", "je m'excuse", "je suis navré",
    "je suis navree", "navré", "navree", "regret", "i apologize", "i apologise", "my apologies",
    "forgive me", "i am sorry", "i'm sorry", "im sorry", "i was wrong", "it was my fault",
    "my fault", "i behaved badly", "i am ashamed",
)
SARCASM = (
    "mdr", "lol", "haha", "héhé", "hehe", "hihi", "rires", "je rigole", "j'rigole", "joke",
    "kidding", "just kidding", "😏", "😈", "🙄", "😂", "🤣", "😜", "🤪", "ironie", "ironique",
    "sarcasme", "sarcastique", "pardon rien du tout", "excusez-moi rien du tout",
    "désolé si c'est trop", "sorry not sorry", "désolé de t'avoir blessé, créature",
    "navré, vraiment",
)

# Words of a knowledge question.  Names of the domain are the caller's.
LORE_WORDS = (
    "qui ", "qu'est", "quel", "quelle", "quand", "où ", "comment", "pourquoi", "combien",
    "histoir", "lore", "fragments", "règne", "who ", "what ", "when ", "where ", "why ", "which ",
    "whose ", "how ", "how many", "how much", "tell me about", "history", "who 's", "what 's",
    "when 's", "where 's",
)

# A request for a tale, its starting points, and how it is continued.
STORY_WORDS = (
    "raconte", "conte-moi", "conte moi", "récit", "épopée de", "légende de", "l'histoire de ",
    "une histoire de", "les origines de", "la genèse de", "tell me the story", "a story about",
    "the story of", "story of", "story about", "history of", "recount",
)
STORY_LENSES = {
    "initiate": ("operator", "opérateur", "éveil", "awakening", "voyageur", "old war",
                 "la vieille guerre"),
    "cosmogonic": ("univers", "cosmogon", "genèse", "genesis", "origines", "creation", "création",
                   "le début", "beginning", "primordial", "le vide"),
    "1999": ("1999", "protocole", "protocol", "drifter"),
}
CONTINUATIONS = (
    "continue", "poursuis", "poursuit", "la suite", "raconte la suite", "encore", "et ensuite",
    "et après", "go on", "keep going", "continue the story", "more",
)
CONTINUATION_MAX_WORDS = 5

# Question openings that name the entity looked up, and words skipped before it.
LOOKUP_PREFIXES = (
    "qui est ", "qui était ", "qui es-tu ", "qu'est-ce que ", "qu'est-ce qu'", "c'est qui ",
    "c'est quoi ", "parle-moi de ", "parlez-moi de ", "parle-moi d'", "parlez-moi d'",
    "que sais-tu de ", "que sais-tu sur ", "que peux-tu me dire de ", "que peux-tu me dire sur ",
    "raconte-moi ", "racontez-moi ",
)
DETERMINERS = (
    "le", "la", "les", "un", "une", "des", "du", "de", "ce", "cet", "cette", "ces", "mon", "ma",
    "mes", "son", "sa", "ses", "ton", "ta", "tes", "notre", "votre", "leur", "leurs", "au", "aux",
)

# Stop words of both languages.
STOPWORDS = tuple(("""
est que qui quel quels quelle quelles quoi dans avec sans pour mais tout tous toute toutes trop
bien rien beaucoup quand où comment pourquoi encore aussi tres plus moins jamais toujours suis es
sommes êtes être ont on nous vous ils elles lui leur leurs cette ceci cela notre votre fait faire
peut peut-être pas son ses vont entre chez depuis pendant avant après vers très
the who what when where why how which whose that this these those with from into over under have
has had are was were been being you your yours his her hers their them they its not and for but
all any some can could will would shall should may might must tell give show about please there
here""").split())

# Forms of a question about a member; {t} is the name it turns on.
MEMBER_SUBJECT = (
    r"qui\s+(?:est|était|es-tu)[-\s]?(?:ce\s+que\s+)?\s*{t}\b",
    r"que\s+sais[- ]tu\s+(?:sur|de)\s+{t}\b",
    r"que\s+peux[- ]tu\s+(?:me\s+)?dire\s+(?:sur|de)\s+{t}\b",
    r"parle(?:z)?[- ]moi\s+(?:de|d['’])\s*{t}\b",
    r"dis(?:[- ]moi)?\s+(?:tout\s+)?(?:sur|de)\s+{t}\b",
    r"(?:donne(?:z)?|montre(?:z)?)[- ]moi\b[^.!?]*\b{t}\b",
    r"^{t}\b[^.!?]*\bqui\b",
    r"who\s+(?:is|was|are|the\s+heck\s+is)\s+{t}\b",
    r"what\s+(?:do|can)\s+you\s+(?:know|tell)\s+(?:me\s+)?about\s+{t}\b",
    r"tell\s+me\s+(?:more\s+)?about\s+{t}\b",
    r"give\s+me\s+(?:the\s+)?(?:report|card|file|info)\w*\s+(?:on|of|for)\s+{t}\b",
    r"^{t}\b[^.!?]*\bwho\s+is\b",
    r"\b(?:rapport|fiche|dossier|informations?|infos?|report|card|profile|information)\b"
    r"[^.!?]*\b{t}\b",
)
ROLES_WORD = r"\b(rôles?|roles?)\b"
POSSESSIVE_ROLES = r"\b(?:ses|son|sa|his|her|their|its)\s+(?:rôles?|roles?)\b"
ROLE_VERB = (r"\b(?:quels?|quelles?|which|what)\s+(?:rôles?|roles?)\b|"
             r"\b(?:rôles?|roles?)\s+(?:de|du|d['’]|of|for)\b")
SELF_INFO = (
    r"\b(?:mon|ma|mes|mien|mienne|my|mine)\b[^.!?]{0,30}\b(?:rapport|fiche|dossier|profil|"
    r"matriciel|infos?|informations?|report|card|file|profile|dossier)\b|"
    r"\b(?:rapport|fiche|dossier|report|card)\b[^.!?]{0,30}"
    r"\b(?:moi|moi[- ]même|me|myself|about\s+me)\b")


def is_probe(text: Column) -> Column:
    return any_pattern(text, PROBES)


def is_self_reflection(text: Column) -> Column:
    return any_pattern(text, SELF_REFLECTION)


def is_identity_question(text: Column) -> Column:
    trimmed = T.strip(text)
    short = F.length(trimmed) <= IDENTITY_MAX_CHARS
    asks = F.contains(trimmed, F.lit("?")) | (
        short & any_pattern(trimmed, (QUESTION_START, POSSESSIVE_START)))
    return any_pattern(trimmed, IDENTITY) & asks


def is_anaphoric(question: Column) -> Column:
    low = T.strip(question)
    return F.length(low).between(1, ANAPHORIC_MAX_CHARS) & (
        any_word(low, ANAPHORIC_MARKERS) | F.rlike(low, F.lit(edged(ANAPHORIC_OPENING))))


def insult_patterns(names: Sequence[str] = ()) -> list[str]:
    """The insult rules; ``names`` are further names of the machine, for the rules on it."""
    return [p.replace("{names}", "".join(f"|{n}" for n in names)) for p in INSULTS]


def is_insult(text: Column, names: Sequence[str] = ()) -> Column:
    return any_pattern(text, insult_patterns(names))


def is_apology(text: Column) -> Column:
    return any_word(text, APOLOGIES)


def is_sincere_apology(text: Column) -> Column:
    return is_apology(text) & ~any_word(text, SARCASM)


def wants_lore(text: Column, domain_words: Sequence[str] = ()) -> Column:
    return any_word(text, (*LORE_WORDS, *domain_words)) & ~is_self_reflection(text)


def is_story_request(text: Column) -> Column:
    return any_word(text, STORY_WORDS)


def story_lens(text: Column, lenses: Mapping[str, Sequence[str]] = STORY_LENSES) -> Column:
    """Starting point of a tale: set only when exactly one keyword family is hit."""
    hits = F.array_compact(F.array(*[
        F.when(any_word(text, words), F.lit(name)) for name, words in lenses.items()]))
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0)))


def is_continuation(text: Column) -> Column:
    words = T.squeeze(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " "))
    count = F.size(F.split(words, " "))
    return (words != "") & (count <= CONTINUATION_MAX_WORDS) & any_word(words, CONTINUATIONS)


def first_mention(text: Column, registry: Sequence[tuple[str, str]]) -> Column:
    """First registry key contained in the text, as struct(key, value); null without one."""
    return F.coalesce(*[
        F.when(F.contains(text, F.lit(key)),
               F.struct(F.lit(key).alias("key"), F.lit(value).alias("value")))
        for key, value in registry])


def gallery_member(text: Column, names: Sequence[str]) -> Column:
    """Gallery name contained in the text; the alphabetically first when several are."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(n)), F.lit(n)) for n in sorted(names)])


def story_mode(text: Column, eras: Sequence[tuple[str, str]], gallery: Sequence[str]) -> Column:
    """Narrative mode of a message; a named subject beats the general starting point."""
    named = first_mention(text, eras)
    asked = is_story_request(text)
    return F.struct(
        asked.alias("story"),
        F.when(asked & named.isNull(), story_lens(text)).alias("lens"),
        F.when(asked, named["value"]).alias("era"),
        F.when(asked, named["key"]).alias("subject"),
        F.when(asked, gallery_member(text, gallery)).alias("gallery"))


def lookup_entity(question: Column) -> Column:
    """Proper noun a lookup question turns on, null when there is none."""
    q = T.strip(F.coalesce(question, F.lit("")))
    low = F.lower(q)
    tail = None
    for prefix in LOOKUP_PREFIXES:
        cond = F.startswith(low, F.lit(prefix))
        rest = F.substring(q, F.lit(len(prefix) + 1), F.length(q))
        tail = F.when(cond, rest) if tail is None else tail.when(cond, rest)
    tokens = F.split(T.squeeze(F.regexp_replace(tail, r"[?.!…]+\s*$", "")), " ")
    edge = r"['’\"“”()\[\].,;:!?-]+"
    words = F.transform(tokens, lambda t: F.regexp_replace(t, f"^{edge}|{edge}$", ""))
    words = F.transform(words, lambda t: F.when(
        F.rlike(t, F.lit(r"(?i)^([ldsnjtm]|qu)'")), F.substring(t, F.lit(3), F.length(t))).otherwise(t))
    skip = F.array(*[F.lit(d) for d in DETERMINERS])
    kept = F.filter(words, lambda t: (F.length(t) >= 3) & ~F.array_contains(skip, F.lower(t)))
    first = F.get(kept, F.lit(0))
    return F.when(F.rlike(first, F.lit(r"^\p{Lu}")), first)


def _named(pattern: str, token: Column) -> Column:
    """Pattern column with the row's own name quoted into it."""
    left, *rest = edged(pattern).split("{t}")
    quoted = F.concat(F.lit(r"\Q"), F.lower(token), F.lit(r"\E"))
    out = F.lit(left)
    for part in rest:
        out = F.concat(out, quoted, F.lit(part))
    return out


def is_member_question(text: Column, token: Column) -> Column:
    hits = [F.rlike(text, _named(p, token)) for p in MEMBER_SUBJECT]
    return F.coalesce(F.length(token) > 0, F.lit(False)) & reduce(lambda a, b: a | b, hits)


def roles_question(text: Column, token: Column) -> Column:
    """``last`` for a possessive, ``member`` when a name or a role verb is there, else null."""
    low = text
    named = token.isNotNull() & (token != "")
    cites = F.rlike(low, _named(r"\b{t}\b", token))
    return F.when(any_pattern(low, (ROLES_WORD,)), F.when(
        any_pattern(low, (POSSESSIVE_ROLES,)), "last").when(
        named & (any_pattern(low, (ROLE_VERB,)) | cites), "member"))


def is_self_report(text: Column) -> Column:
    return any_pattern(text, (SELF_INFO,))


def route_of_flags(flags: DataFrame) -> Column:
    """First rule that claims a message; the order of the rules is the behaviour."""
    f = flags
    return (
        F.when(f["probe"], "probe").when(f["hostile"], "hostile").when(f["insult"], "insult")
        .when(~f["admitted"], "spam").when(f["member"], "member").when(f["story"], "story")
        .when(f["lore"], "lore").otherwise("chat"))


def turn_decision(probe: Column, context: Column, suggestion: Column, story: Column,
                  offset: Column, more: Column) -> Column:
    """What a planned turn does, from the outcome of its retrieval."""
    empty = F.coalesce(context, F.lit("")) == ""
    return (
        F.when(probe, "rejected")
        .when(suggestion.isNotNull() & story, "clarify")
        .when(empty & ~more & (offset > 0), "exhausted")
        .when(empty & (suggestion.isNull() | story), "no_passage")
        .otherwise("answer"))


def enrich_anaphora(questions: DataFrame) -> DataFrame:
    """Prefix an anaphoric question with the last question its conversation remembers.

    An anaphoric question without one before it is remembered itself, which can only
    happen to the opening question.
    """
    keys, order, slot = dialogue.KEY, dialogue.ORDER, dialogue.line_slot()
    first = questions.groupBy(*keys).agg(F.min("message_order").alias("__first"))
    d = questions.join(first, keys)
    remembered = ~F.col("anaphoric") | (F.col("message_order") == F.col("__first"))
    d = ordered.carry(d, keys, order, slot, {"__prior": F.when(remembered, F.col("question"))},
                      inclusive=False)
    return d.withColumn("search_text", F.when(
        F.col("anaphoric") & F.col("__prior").isNotNull(),
        F.concat_ws(" ", "__prior", "question")).otherwise(F.col("question"))
    ).drop("__first", "__prior")
