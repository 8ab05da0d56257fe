"""Dialogue messages: junk and speaker tests, reference forms, infobox fields."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions import wikitext as X

# Interface labels and mechanics words that never belong to a dialogue.
JUNK_WORDS = ("known issue", "reward", "new", "complete quest", "banishing", "drop chance",
              "update", "fix", "blueprint")
_WORDS = "|".join(JUNK_WORDS)
_EDGE = "[^0-9A-Za-z_À-ÿ]"
JUNK_IN_SPEAKER = rf"(?i)(?:^|{_EDGE})(?:{_WORDS})(?:s|d|ed|es|ing|en)?(?:{_EDGE}|$)"
JUNK_LABEL = rf"(?i)^\s*(?:{_WORDS})\s*(?:$|[:-])"
NUMERIC_ONLY = r"^[\d\s.,%\-/()]+$"


def is_junk(speaker: Column, message: Column) -> Column:
    """Bare numbers, a junk word in the speaker, or a junk label leading the message."""
    return (F.rlike(T.strip(message), F.lit(NUMERIC_ONLY))
            | F.rlike(speaker, F.lit(JUNK_IN_SPEAKER)) | F.rlike(message, F.lit(JUNK_LABEL)))


def _name(candidate: Column, size: int, forbidden: str) -> Column:
    return ((F.length(candidate) <= size) & ~F.rlike(candidate, F.lit(forbidden))
            & F.rlike(candidate, F.lit(r"^\p{Lu}")))


def is_speaker(candidate: Column) -> Column:
    return _name(candidate, 40, r"[*_\]}:]")


def is_speaker_strict(candidate: Column) -> Column:
    """Stricter form for chunk metadata: shorter, no brackets, no sentence punctuation."""
    return _name(candidate, 24, r"[*_\]}(\[>.,?!]")


def slug(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9]+", "")


_NAV = r"(?:continues?|contiue|same|goes|jump)"
DISPLAY_RULES = (
    (r"(?i)\{(?!.*\bends\b)[^{}\n]*?" + _NAV + r"[^{}\n]*\}", ""),
    (r"(?i)\{\s*if\s+[^{}]*\}", ""), (r"(?i)\{P\d+\}", ""), (r"\s+", " "))
CONVERSATION_ENDS = r"(?i)\{convo[^}\n]{0,16}ends\.?\}"
# Order matters: page pauses, conditions, quote marks, closing punctuation, white space.
SCRIPT_REF_RULES = ((r"\{p\s*\d+\}", " "), (r"\{[^{}]*\}", " "), (r"^>+\s*", ""),
                    (r"[.!?]+$", ""), (r"\s+", " "))
REF_CHARS = 120


def display_text(text: Column) -> Column:
    """Message without navigation notes, conditions and pause marks."""
    return F.trim(T.chain(text, DISPLAY_RULES))


def ends_conversation(text: Column) -> Column:
    return F.rlike(text, F.lit(CONVERSATION_ENDS))


def graph_ref(text: Column) -> Column:
    """Normal form under which the graph looks up a jump target."""
    bare = T.squeeze(F.regexp_replace(text, CONVERSATION_ENDS, ""))
    bare = T.strip(F.regexp_replace(bare, r"^[*]+|[*]+$", ""))
    return F.substring(F.lower(bare), 1, REF_CHARS)


def script_ref(text: Column) -> Column:
    """Normal form under which a script line is found by its opening words."""
    return T.strip(T.chain(F.lower(text), SCRIPT_REF_RULES))


# Words of a speaker who is the player.
PLAYER_WORDS = ("operator", "player", "drifter")


def is_player(speaker: Column, words: tuple[str, ...] = PLAYER_WORDS) -> Column:
    return F.rlike(speaker, F.lit("(?i)" + "|".join(words)))


# Markup inside an infobox that its values are freed of, links first so that no bar is left, by the
# mark without which a rule cannot match.
BOX_RULES = (
    ("[", ((r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]", "$1"), (r"\[\[([^\[\]]*)\]\]", "$1"),
           (r"\[https?://\S+\s+([^\[\]]*)\]", "$1"))),
    ("<", ((r"<[^<>]*>", ""),)), ("''", ((r"'{2,}", ""),)),
)
_INNER = ((r"(?i)\{\{(?![^{}|]*infobox)[^{}]*\}\}", ""),)
_BOX = r"(?i)\{\{[^{}|]*infobox[^{}|]*\|([^{}]*)\}\}"


def _fields(body: Column) -> Column:
    """Map of an infobox body: name = value between bars, the last value of a name counts."""
    parts = F.transform(F.split(body, r"\|"), lambda p: F.struct(
        T.trim_blank(F.when(F.contains(p, F.lit("=")), F.substring_index(p, "=", 1))).alias("name"),
        T.trim_blank(F.regexp_replace(p, r"(?s)\A[^=]*=", "")).alias("value")))

    # A part without a name is numbered among those without one.  Lists that are read for each of
    # their elements are bound first, or each element would compute them again.
    def number(parts):
        return F.transform(parts, lambda p, i: F.struct(
            F.coalesce(p["name"], F.size(F.filter(
                F.slice(parts, F.lit(1), i + 1), lambda q: q["name"].isNull())).cast("string")).alias(
                "name"), p["value"].alias("value")))

    def last(full):
        return F.filter(full, lambda p, i: ~F.exists(
            F.slice(full, i + 2, F.size(full)), lambda q: q["name"] == p["name"]))

    full = F.filter(_bound(parts, number), lambda p: (p["name"] != "") & (p["value"] != ""))
    return F.map_from_entries(_bound(full, last))


def _bound(rows: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of an array that is computed once, whatever the type of the outcome."""
    return F.get(F.transform(F.array(rows), use), F.lit(0))


def infobox(wikitext: Column) -> Column:
    """Fields of the first infobox that has any, as a map; empty without one."""
    clean = T.chain_if(wikitext, "<!--", ((r"(?s)<!--.*?-->", ""),))
    flat = reduce(lambda text, r: T.chain_if(text, *r), BOX_RULES, T.let(
        clean, lambda text: X.innermost_first(text, _INNER)))
    bodies = F.regexp_extract_all(flat, F.lit(_BOX), F.lit(1))
    boxes = F.filter(F.transform(bodies, _fields), lambda m: F.size(m) > 0)
    return F.coalesce(F.get(boxes, F.lit(0)), F.create_map().cast("map<string,string>"))


SECTION_RULES = (
    (r"(?s)<!--.*?-->", ""), (r"(?s)\{\|.*?\|\}", ""), (r"\{\{[^{}]*\}\}", ""),
    (r"(?is)<ref[^>]*>.*?</ref>", ""), (r"<[^>]+>", " "),
    (r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]", "$1"), (r"\[\[([^\[\]]*)\]\]", "$1"),
    (r"'{2,}", ""),
    (r"(?m)^={4,}\s*(.*?)\s*={4,}\s*$", "#### $1"), (r"(?m)^===\s*(.*?)\s*===\s*$", "### $1"),
    (r"(?m)^==\s*(.*?)\s*==\s*$", "## $1"),
)
