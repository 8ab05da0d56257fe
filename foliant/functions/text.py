"""Column functions over text: normalising, folding, trimming, counting, snippets."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accented letters and their plain forms, position by position.
ACCENTED = "àâäáãåçèéêëẽíìîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeeiiiinooooouuuuyy"
# Digits read as letters in typed names.
LEET_DIGITS, LEET_LETTERS = "310457", "eloast"

LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"


def chain(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Apply ordered (pattern, replacement) rules as one JVM expression."""
    return reduce(lambda c, r: F.regexp_replace(c, F.lit(r[0]), F.lit(r[1])), rules, text)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add or replace a column that is computed exactly once per row.

    Catalyst inlines a projected expression into whatever uses it and pushes filters
    through projections, so a chain of stages that each read their input several times
    would be re-evaluated exponentially often.  A one-element explode is a barrier to both.
    """
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.explode(F.array(value)).alias(name))


def strip(text: Column) -> Column:
    """Trim every kind of white space at both ends (no pattern: this runs per line)."""
    return F.btrim(text, F.lit(" \t\n\r\f\x0b"))


def trim_blank(text: Column) -> Column:
    """Trim every Unicode blank at both ends."""
    blank = r"[\p{Z}\t-\r\x1c-\x1f\x85]+"
    return F.regexp_replace(text, rf"\A{blank}|{blank}\z", "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Bind an expression that ``use`` reads several times, so it is computed once."""
    return F.aggregate(F.array(F.lit(0)), value, lambda bound, _: use(bound))


def chain_if(text: Column, marker: str | Sequence[str], rules: Sequence[tuple[str, str]]) -> Column:
    """Rules that can only match where the marker, or one of several, stands; other texts pass
    untouched."""
    markers = [marker] if isinstance(marker, str) else marker
    return let(text, lambda t: F.when(reduce(lambda a, b: a | b, [
        F.contains(t, F.lit(m)) for m in markers]), chain(t, rules)).otherwise(t))


def squeeze(text: Column) -> Column:
    """Collapse white-space runs to one space and trim."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def clean_lines(text: Column) -> Column:
    """Trimmed, non-empty lines."""
    return F.filter(F.transform(lines(text), strip), lambda x: x != "")


def fold_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)


def fold_leet(text: Column) -> Column:
    return F.translate(text, LEET_DIGITS, LEET_LETTERS)


def normalize_key(text: Column) -> Column:
    """Lower case, one space between words.  Compatibility folding of exotic code points
    (NFKC) is left to :func:`normalize_key_nfkc`."""
    return squeeze(F.lower(F.coalesce(text, F.lit(""))))


def sanitize_filename(location: Column) -> Column:
    """File name of a hashed texture path: last segment, safe characters only."""
    base = F.substring_index(location, "/", -1)
    hashed = F.instr(base, "!00_") > 0
    digest = F.regexp_replace(base, r"^.*?!00_", "")
    name = F.substring_index(base, "!00_", 1)
    stem = F.when(hashed & (digest != ""), F.concat(name, F.lit("__00_"), digest)).otherwise(name)
    return F.regexp_replace(stem, r"[^A-Za-z0-9_.+-]", "_")


def route_id(path: Column, namespace: str = "fr") -> Column:
    """Stable page id of a site route; the ranges of the namespaces do not overlap."""
    digest = F.crc32(F.concat(F.lit(f"{namespace}:"), path).cast("binary"))
    if namespace == "en":
        return digest.bitwiseAND(F.lit(0x3FFFFFFF)).bitwiseOR(F.lit(1 << 31))
    return digest.bitwiseAND(F.lit(0x7FFFFFFF))


def mirror_id(title: Column) -> Column:
    """Page id of a mirror-wiki title, in a range of its own."""
    digest = F.crc32(F.concat(F.lit("frwiki:"), title).cast("binary"))
    return digest.bitwiseAND(F.lit(0x3FFFFFFF)).bitwiseOR(F.lit(3 << 30))


def add_suffix(title: Column, suffix: str = " (fr)") -> Column:
    return F.concat(title, F.lit(suffix))


def drop_suffix(title: Column, suffix: str = " (fr)") -> Column:
    n = len(suffix)
    return F.when(F.endswith(title, F.lit(suffix)),
                  F.substring(title, F.lit(1), F.length(title) - n)).otherwise(title)


def parse_iso(text: Column) -> Column:
    """ISO time stamp, null when it does not parse."""
    return F.try_to_timestamp(text)


def lexeme_forms(word: Column) -> Column:
    """Spellings under which a word may stand in the archive: plural, feminine, unaccented."""
    size = F.length(word)
    singular = F.when(F.endswith(word, F.lit("s")), F.substring(word, F.lit(1), size - 1)
                      ).otherwise(word)
    stem = F.when(F.endswith(singular, F.lit("e")),
                  F.substring(singular, F.lit(1), F.length(singular) - 1)).otherwise(singular)
    base = F.array(word, stem, *[F.concat(stem, F.lit(e)) for e in ("s", "e", "es")])
    both = F.concat(base, F.transform(base, fold_accents))
    ic = F.transform(
        F.filter(both, lambda f: F.endswith(f, F.lit("ique"))),
        lambda f: F.concat(F.substring(f, F.lit(1), F.length(f) - 4), F.lit("ic")))
    return F.array_sort(F.array_distinct(F.concat(both, ic)))


WORD = rf"[{LATIN}][{LATIN}0-9_'-]*"


def query_terms(question: Column) -> Column:
    """Distinct word tokens of three letters or more, in order of appearance."""
    tokens = F.regexp_extract_all(F.lower(question), F.lit(f"({WORD})"), F.lit(1))
    return F.array_distinct(F.filter(tokens, lambda t: F.length(t) >= 3))


def content_words(text: Column, stopwords: Sequence[str], min_len: int = 4,
                  limit: int = 6) -> Column:
    """Salient words: capitalised ones first, stop words and short words left out."""
    tokens = F.regexp_extract_all(text, F.lit(f"([{LATIN}][{LATIN}0-9_]*)"), F.lit(1))
    stop = F.array(*[F.lit(s) for s in stopwords])
    kept = F.filter(tokens, lambda t: (F.length(t) >= min_len)
                    & ~F.array_contains(stop, F.lower(t)))
    upper = F.lit("^[A-ZÀ-ÖØ-Þ]")
    proper = F.filter(kept, lambda t: F.rlike(t, upper))
    other = F.filter(kept, lambda t: ~F.rlike(t, upper))
    return F.slice(F.array_distinct(F.concat(proper, other)), 1, limit)


CONTEXT_PREFIX = r"\APage: [^\n]+?(?: \| Section: [^\n]*?)? - "


def strip_context_prefix(content: Column) -> Column:
    return strip(F.regexp_replace(content, CONTEXT_PREFIX, ""))


def section_label(metadata: Column) -> Column:
    """The stored section, or the chain of level 2-6 headings."""
    heads = F.concat_ws(" > ", *[F.try_element_at(metadata, F.lit(f"Header {i}"))
                                 for i in range(2, 7)])
    stored = F.try_element_at(metadata, F.lit("section"))
    return F.when(F.length(stored) > 0, stored).otherwise(heads)


# Channel weights of the fused score.
COSINE_WEIGHT, LEXICAL_WEIGHT = 0.6, 0.4


def squash_rank(rank: Column) -> Column:
    """Lexical rank brought to [0, 1): r / (1 + r), nothing below zero."""
    r = F.coalesce(rank, F.lit(0.0))
    return F.when(r < 0, F.lit(0.0)).otherwise(r / (1.0 + r))


def fuse(cosine: Column, lexical: Column) -> Column:
    """Weighted sum of both channels; a missing channel adds nothing."""
    return (F.coalesce(cosine * COSINE_WEIGHT, F.lit(0.0))
            + F.coalesce(lexical * LEXICAL_WEIGHT, F.lit(0.0)))


# Markup wiped from a display snippet, in order.
SNIPPET_RULES = (
    (r"\|[-|]+\|?\s*", " "),
    (r"\{[^}]+\}", " "),
    (r"_[^_]+_?", " "),
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"==[^=]+==", " "),
    (r"~{2}[^~]+~{2}", " "),
    (r"\[[^\]]*\]", " "),
    (r"[|]", " "),
    (r"\s+", " "),
)


def snippet(content: Column, needle: Column, radius: int = 60) -> Column:
    """Text around the first hit, cleaned, with ellipses where it was cut."""
    at = F.instr(F.lower(content), needle) - 1
    start = F.greatest(F.lit(0), at - radius)
    part = F.when(at < 0, F.substring(content, F.lit(1), F.lit(2 * radius))).otherwise(
        F.substring(content, start + 1, at + radius - start))
    body = strip(chain(strip(part), SNIPPET_RULES))
    head = F.when(at > radius, F.lit("…")).otherwise(F.lit(""))
    tail = F.when((at >= 0) & (at < F.length(content) - radius), F.lit("…")).otherwise(F.lit(""))
    return F.concat(head, body, tail)


# Control characters and chat mention tokens.
CONTROL_CHARS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
MENTIONS = r"(?i)<@!?\d+>|<#\d+>|<a?:[a-z0-9_]+:\d+>"
QUERY_LIMIT = 2000


def sanitize_query(text: Column, mention_label: str = "un utilisateur") -> Column:
    cleaned = chain(text, ((CONTROL_CHARS, " "), (MENTIONS, mention_label)))
    return F.substring(squeeze(cleaned), 1, QUERY_LIMIT)


def resolve_alias(text: Column, aliases: Sequence[tuple[str, str, str]]) -> Column:
    """First alias (in registry order) found in the text → struct(text, note, canonical)."""
    low = F.lower(text)

    def hit(alias, canon, note):
        return F.struct(F.concat(text, F.lit(f" ({canon})")).alias("expanded"),
                        F.lit(note).alias("note"), F.lit(canon).alias("canonical"))

    miss = F.struct(text.alias("expanded"), F.lit("").alias("note"), F.lit("").alias("canonical"))
    out = None
    for alias, canon, note in aliases:
        cond = F.contains(low, F.lit(alias.lower()))
        out = F.when(cond, hit(alias, canon, note)) if out is None else out.when(
            cond, hit(alias, canon, note))
    return miss if out is None else out.otherwise(miss)


def word_count(text: Column) -> Column:
    stripped = strip(text)
    return F.when(stripped == "", 0).otherwise(F.size(F.split(stripped, r"\s+"))).cast("long")


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def rank_label(conversation_id: Column) -> Column:
    n = F.regexp_extract(conversation_id, r"(?i)Rank\s*(\d+)", 1)
    return F.when(n != "", F.concat(F.lit("Rank "), n)).otherwise(F.lit(""))


def name_variants(name: Column) -> Column:
    """Spellings of a camel-case name: the whole, its first and its last part."""
    parts = F.split(name, r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Ý])")
    return F.array_distinct(F.transform(
        F.array(name, F.element_at(parts, 1), F.element_at(parts, -1)), F.lower))


def cites_name(text: Column, variants: Column) -> Column:
    """Whether any spelling stands in the text as a whole word."""
    return F.exists(variants, lambda v: F.rlike(
        F.lower(text), F.concat(F.lit(r"(?U)\b\Q"), v, F.lit(r"\E\b"))))


def replace_first(text: Column, needle: Column, replacement: Column) -> Column:
    """Case-insensitive replacement of the first occurrence only."""
    at = F.instr(F.lower(text), F.lower(needle))
    return F.when(at > 0, F.concat(
        F.substring(text, F.lit(1), at - 1), replacement,
        F.substring(text, at + F.length(needle), F.length(text)))).otherwise(text)


def strip_padding(text: Column) -> Column:
    """Drop a trailing run of dashes, stars and blanks; a closer stuck to a word stays."""
    closed = F.rlike(text, F.lit(r"[\p{L}\p{N}][*-]{1,2}\z"))
    return F.when(closed, text).otherwise(F.regexp_replace(text, r"[*\-\s]+\z", ""))


def replace_mentions(text: Column, names: Column) -> Column:
    """Replace ``<@id>`` and ``<@!id>`` through a map id → display name."""
    return F.trim(F.aggregate(
        F.map_entries(names), text,
        lambda acc, e: F.replace(F.replace(acc, F.concat(F.lit("<@"), e["key"], F.lit(">")),
                                           e["value"]),
                                 F.concat(F.lit("<@!"), e["key"], F.lit(">")), e["value"])))


def metadata_map(pairs: Mapping[str, Column]) -> Column:
    """Map of the present values only."""
    entries = [x for k, v in pairs.items() for x in (F.lit(k), v)]
    return F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull() & (v != ""))
