"""Wiki markup to Markdown as column expressions; the order of the stages is the behaviour."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T

# Template names that mark a page as speculative, or as confirmed.
NON_CANON_TEMPLATES = ("speculation", "conjecture", "theory")
CANON_TEMPLATES = ("canon", "confirmed", "in-game")
MARKER_NON_CANON = "NON-CANON / SPECULATION JOUEUR"
MARKER_CANON = "CANON OFFICIEL"

# Templates dropped with their content (name part, or exact name).
NOISE_PARTS = ("infobox", "modsbox", "bodysection")
NOISE_NAMES = (
    "questtopnav", "tocright", "cleanup", "stub", "construct", "tocleft", "navbox", "topnav",
    "bottomnav", "clr", "clear", "prettytable", "transclude", "main", "for", "about", "otheruses",
    "redirect", "story and history", "updateme", "toc", "dpl", "dpl2", "transcriptnav", "questnav",
    "quest navigation", "topcat", "dynamicpagelist", "dplsource", "character", "characterinfo",
    "charactertopnav", "characternav", "charnav", "charbottom", "factionbox", "factionnav",
    "factiontopnav", "syndicatenav", "syndicatetopnav", "wavetable", "localizationtable", "upcoming",
    "image needed", "accurate", "update", "citation needed", "fact",
)

# Section titles left out as gameplay, and titles that are always kept.
GAMEPLAY_SECTIONS = (
    "stats", "statistics", "statistics table", "abilities", "weapon stats", "build", "crafting",
    "acquisition", "blueprint", "components", "drops", "see also", "tips", "trivia gameplay",
    "patch history", "media", "gallery", "notes", "external links", "references",
    "codex entries gameplay",
)
LORE_SECTIONS = ("lore", "background", "history", "story", "dialogue", "dialog", "quotes",
                 "cinematic", "transcript")

# Comments, tables, code and parser functions.
BLOCK_RULES = (
    (r"(?s)<!--.*?-->", ""),
    (r"(?s)\{\|.*?\|\}", ""),
    (r"(?is)<syntaxhighlight\b.*?</syntaxhighlight>|<source\b.*?</source>|<code\b.*?</code>", ""),
    (r"(?i)\{\{#(?:invoke|if|ifeq|ifexpr|expr|switch|titleparts|lst|lsth|lstx)[^{}]*\}\}", ""),
)
# HTML tags and what they become.
TAG_RULES = (
    (r"(?i)</?(?:table|tr|ul|ol|br|div)[^>]*>", "\n"), (r"(?i)</?(?:td|th)[^>]*>", " | "),
    (r"(?i)</?li[^>]*>", "\n* "), (r"(?i)</?(?:b|strong)>", "**"), (r"(?i)</?(?:i|em)>", "_"),
    (r"(?i)</?p[^>]*>", "\n\n"), (r"(?i)</?u>|</?span[^>]*>", ""),
    (r"(?i)<ref[^>/]*/>", ""), (r"(?is)<ref[^>]*>.*?</ref>", ""), (r"<[^>]+>", " "),
)
TRANSCLUSION_RULES = ((r"(?i)</?(?:noinclude|includeonly|onlyinclude)>", ""),)
FILE_RULES = ((r"(?i)\[\[(?:File|Image)\s*:[^\]]*\]\]|\[\d+[^\]]*\]", ""),)
GALLERY_RULES = ((r"(?is)<\s*gallery[^>]*>.*?<\s*/\s*gallery\s*>", ""),)
EMPHASIS_RULES = ((r"'''''(.*?)'''''", "**_$1_**"), (r"'''(.*?)'''", "**$1**"),
                  (r"''(.*?)''", "_$1_"))
# Links: piped → label, blank label → target, plain → target without namespace and section.
LINK_RULES = (
    (r"\[\[[^\[\]|]*\|\s*([^\[\]\s](?:[^\[\]]*[^\[\]\s])?)\s*\]\]", "$1"),
    (r"\[\[([^\[\]|]*)\|\s*\]\]", "[[$1]]"),
    (r"\[\[([^\[\]#]*)#[^\[\]]*\]\]", "[[$1]]"),
    (r"(?i)\[\[(mediawiki[^\[\]]*)\]\]", "$1"),
    (r"\[\[(?:[^\[\]:]*:)?\s*([^\[\]]*?)\s*\]\]", "$1"),
    (r"\[https?://[^\s\[\]]+\s+([^\]]+)\]", "$1"),
    (r"\[(https?://[^\s\[\]]+)\]", "$1"),
)
HEADING_RULES = (
    (r"(?m)^={6,}[ \t]*(.*?)[ \t]*(?:={2,}|$)", "\n\n###### $1\n"),
    (r"(?m)^={5}[ \t]*(.*?)[ \t]*(?:={2,}|$)", "\n\n##### $1\n"),
    (r"(?m)^={4}[ \t]*(.*?)[ \t]*(?:={2,}|$)", "\n\n#### $1\n"),
    (r"(?m)^={3}[ \t]*(.*?)[ \t]*(?:={2,}|$)", "\n\n### $1\n"),
    (r"(?m)^={2}[ \t]*(.*?)[ \t]*(?:={2,}|$)", "\n\n## $1\n"),
    (r"(?m)^#{3,}\s*", "## "),
)
INDENT_RULES = ((r"(?m)^:+\s?", ""), (r"(?m)^#(\s|\d)", "- $1"), (r"(?m)^;\s*", ""))
BLANK_RULES = ((r"\n{3,}", "\n\n"), (r"(?m)^\s+", ""))
# Navigation words of an instruction in braces.
_NAV = r"(?:continues?|contiue|same|goes|jump)"
POINTER_LINE = (r"(?im)^>[ \t]*(?:\*{1,3}[ \t]*)?(?:>[ \t]*)?(?:\{[^{}:\n]*\}\s*)*?"
                r"\{[^{}:\n]*?" + _NAV + r"[^{}:\n]*")
INSTRUCTION_RULES = (
    (POINTER_LINE, ""),
    (r"(?i)\{(?!.*\bends\b)[^{}\n]*?" + _NAV + r"[^{}\n]*\}", ""),
    (r"(?i)\{\s*if\s+[^{}]*\}", ""),
    (r"(?i)\{P\d+\}", ""),
    (r"\A\s*>?\s*\*{1,2}\s*\z", ""),
    (r"(?m)(^\s*[*>\-]+\s*)\*\*[ \t]+(?=[\p{L}\p{N}_])", "$1**"),
    (r"[ \t]+(?=\n)", ""),
)
# Sound file names.
AUDIO_RULES = ((r"(?i)\b[a-z0-9_]+[ \t]{1,3}en\.(?:ogg|mp3)\b", ""),
               (r"(?i)[\p{L}\p{N}_][\p{L}\p{N}_-]*\.(?:ogg|mp3|wav)\b", ""))
FOOTER_LINE = r"(?i)^(?:(?:quotesnav|quotes|sentient)$|update\s+\d+)"
HEADING_LINE = r"^(={2,6}|#{1,6})\s*(.*?)\s*(?:={0,2}|#*)\s*$"


def _begins(*starts: str) -> tuple[str, ...]:
    """Each start with its last letter in both cases."""
    return tuple(x for s in starts for x in dict.fromkeys((s[:-1] + s[-1].lower(),
                                                           s[:-1] + s[-1].upper())))


# By pattern: pieces of text, one of which stands in whatever the rule matches.  Looking for them is
# cheaper than the pattern, and on most texts spares it.  Letters of a rule are those of ASCII.
MARKS = {
    BLOCK_RULES[0][0]: ("<!--",), BLOCK_RULES[1][0]: ("{|",),
    BLOCK_RULES[2][0]: _begins("</s", "</c"), BLOCK_RULES[3][0]: ("{{#",),
    TAG_RULES[1][0]: _begins("<t", "</t"), TAG_RULES[2][0]: _begins("<l", "</l"),
    TAG_RULES[4][0]: _begins("<i", "<e", "</i", "</e"), TAG_RULES[5][0]: _begins("<p", "</p"),
    TAG_RULES[6][0]: _begins("<u", "<s", "</u", "</s"), TAG_RULES[7][0]: ("/>",),
    TAG_RULES[8][0]: _begins("</r"), TAG_RULES[9][0]: ("<",),
    EMPHASIS_RULES[0][0]: ("'''''",), EMPHASIS_RULES[1][0]: ("'''",), EMPHASIS_RULES[2][0]: ("''",),
    LINK_RULES[0][0]: ("|",), LINK_RULES[1][0]: ("|",), LINK_RULES[2][0]: ("#",),
    LINK_RULES[3][0]: _begins("[[m"), LINK_RULES[4][0]: ("[[",), LINK_RULES[5][0]: ("[http",),
    LINK_RULES[6][0]: ("[http",),
    **{rule[0]: ("=" * n,) for rule, n in zip(HEADING_RULES, (6, 5, 4, 3, 2))},
    HEADING_RULES[5][0]: ("###",),
    INDENT_RULES[0][0]: (":",), INDENT_RULES[1][0]: ("#",), INDENT_RULES[2][0]: (";",),
    BLANK_RULES[0][0]: ("\n\n\n",),
    **{rule[0]: ("{",) for rule in INSTRUCTION_RULES[:3]}, INSTRUCTION_RULES[3][0]: _begins("{p"),
    INSTRUCTION_RULES[4][0]: ("*",), INSTRUCTION_RULES[5][0]: ("** ", "**\t"),
    INSTRUCTION_RULES[6][0]: (" \n", "\t\n"),
}


def _chain(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """T.chain, each rule only where one of its MARKS stands."""
    for rule in rules:
        marks = MARKS.get(rule[0])
        text = T.chain(text, [rule]) if marks is None else T.chain_if(text, marks, [rule])
    return text


def _names(names: Sequence[str]) -> str:
    return "|".join(names)


def has_template(text: Column, names: Sequence[str]) -> Column:
    """Whether a template of that name stands anywhere in the text, nested ones included."""
    return F.rlike(text, F.lit(rf"(?i)\{{\{{\s*({_names(names)})\s*[|}}]"))


def has_non_canon(text: Column) -> Column:
    return has_template(text, NON_CANON_TEMPLATES)


def has_canon(text: Column) -> Column:
    return has_template(text, CANON_TEMPLATES)


def strip_blocks(text: Column) -> Column:
    return _chain(text, (*BLOCK_RULES[::2], *BLOCK_RULES[1::2]))


def convert_tags(text: Column) -> Column:
    return T.let(text, lambda t: F.when(F.contains(t, F.lit("<")), _chain(t, TAG_RULES)).otherwise(t))


def strip_references(text: Column) -> Column:
    """Transclusion tags, then file and image references."""
    return T.chain_if(T.chain_if(text, "<", TRANSCLUSION_RULES), "[", FILE_RULES)


_ARG = r"([^{}|]*)"


def _narrative_rules() -> tuple[tuple[str, str], ...]:
    tail = r"(?:\|[^{}]*)?\}\}"
    rules = [
        (rf"(?i)\{{\{{\s*quote\s*\|\s*{_ARG}\|\s*in-game description\s*{tail}", '\n> "$1"'),
        (rf"(?i)\{{\{{\s*quote\s*\|\s*([^{{}}|]*?)\s*\|\s*([^{{}}|]*[^{{}}|\s])\s*{tail}",
         '\n> "$1"\n> — $2'),
        (r"(?i)\{\{\s*quote\s*(?:\|\s*([^{}|]*?)\s*)?\|?\s*\}\}", '\n> "$1"'),
        (rf"(?i)\{{\{{\s*spoiler\s*\|\s*([^{{}}|]*?)\s*{tail}", "\n> *_SPOILERS_* _: $1_"),
        (r"(?i)\{\{\s*spoiler\s*\}\}", "\n> *_SPOILERS_* _: Spoiler_"),
    ]
    for names, marker in ((NON_CANON_TEMPLATES, MARKER_NON_CANON), (CANON_TEMPLATES, MARKER_CANON)):
        head = rf"(?i)\{{\{{\s*(?:{_names(names)})\s*"
        rules += [
            (rf"{head}\|\s*([^{{}}|]*[^{{}}|\s])\s*{tail}", f"\n> **[{marker}]** $1\n"),
            (rf"{head}(?:\|\s*)?\}}\}}", f"\n> **[{marker}]**\n"),
        ]
    return tuple(rules)


NARRATIVE_RULES = _narrative_rules()
_NOISE = rf"(?:[^{{}}|]*(?:{_names(NOISE_PARTS)})[^{{}}|]*|\s*(?:{_names(NOISE_NAMES)})\s*)"
NOISE_RULES = ((rf"(?i)\{{\{{{_NOISE}(?:\|[^{{}}]*(?:\{{\{{[^{{}}]*\}}\}}[^{{}}]*)*)?\}}\}}", ""),)
FLATTEN_RULES = ((r"\{\{[^{}|]*\|\s*([^{}]*?)\s*\}\}", "$1"),
                 (r"\{\{\s*([^{}|]*?)\s*\}\}", "$1"))


def template_depth(text: Column) -> Column:
    """How deep templates nest; braces without a partner count as open."""
    marks = F.regexp_extract_all(text, F.lit(r"(\{\{|\}\})"), F.lit(1))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(marks, start, lambda s, mark: F.struct(
        F.when(mark == "{{", s["now"] + 1).otherwise(F.greatest(s["now"] - 1, F.lit(0))).alias("now"),
        F.greatest(s["most"], F.when(mark == "{{", s["now"] + 1).otherwise(0)).alias("most")),
        lambda s: s["most"])


def innermost_first(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Apply rules for flat templates once per level of nesting, so that none is left.

    Braces that are never closed count as levels too, but the first pass that changes nothing is
    the last.
    """
    passes = F.when(F.contains(text, F.lit("{{")), F.sequence(
        F.lit(0), template_depth(text))).otherwise(F.array().cast("array<int>"))

    def apply(state):
        # An array of one element, so that the rules run once for both fields.
        return F.get(F.transform(F.array(T.chain(state["text"], rules)), lambda new: F.struct(
            new.alias("text"), (new != state["text"]).alias("open"))), F.lit(0))

    start = F.struct(text.alias("text"), F.lit(True).alias("open"))
    return F.aggregate(passes, start, lambda state, _: F.when(
        state["open"], apply(state)).otherwise(state), lambda state: state["text"])


def render_narrative(text: Column) -> Column:
    """Quote, spoiler and reliability templates as block quotes."""
    # A rule adds no text right behind braces, so the words that rules look for there are those of
    # the text before.
    groups = ((("in-game description",), 1), (("quote",), 2), (("spoiler",), 2),
              (NON_CANON_TEMPLATES, 2), (CANON_TEMPLATES, 2))

    def render(t: Column, low: Column) -> Column:
        at = 0
        for words, count in groups:
            rules = NARRATIVE_RULES[at:at + count]
            t = T.let(t, lambda t: F.when(_mentions(low, words), T.chain(t, rules)).otherwise(t))
            at += count
        return t

    return T.let(text, lambda t: F.when(F.contains(t, F.lit("{{")), T.let(F.lower(t), lambda low: render(
        t, low))).otherwise(t))


def drop_noise(text: Column) -> Column:
    """Noise templates by name part or exact name, one level of nesting included.

    Those that nest deeper go in :func:`flatten_templates`, once their inner ones are flat.
    """
    return T.chain_if(text, "{{", NOISE_RULES)


def flatten_templates(text: Column) -> Column:
    """Remaining templates, innermost first: noise goes, others give their arguments or name."""
    return innermost_first(text, (*NOISE_RULES, *FLATTEN_RULES))


def template_residue(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\{\{"))


BULLET = "\u0001"


def protect_bullets(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)^\*+[ \t]*", BULLET)


def emphasis(text: Column) -> Column:
    return _chain(text, EMPHASIS_RULES)


def normalise_links(text: Column) -> Column:
    return T.let(text, lambda t: F.when(F.contains(t, F.lit("[")), _chain(t, LINK_RULES)).otherwise(t))


def heading_title_key(title: Column) -> Column:
    return F.regexp_replace(F.lower(title), "[^a-z0-9 ]", "")


def _mentions(key: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(key, F.lit(w)) for w in words])


def drop_gameplay(df: DataFrame, column: str) -> DataFrame:
    """Cut gameplay sections.

    A block ends at a lore heading or at a heading of the same or a shallower level;
    deeper headings inside it stay, their text does not.
    """
    from foliant.operators.chunks import segment, with_segments

    def mark(line):
        key = heading_title_key(F.regexp_extract(line, HEADING_LINE, 2))
        level = F.length(F.regexp_extract(line, HEADING_LINE, 1))
        plain = F.struct(F.lit(0).alias("level"), F.lit(False).alias("lore"),
                         F.lit(False).alias("game"))
        # The key is bound: inlined, it would be made again for each of the words.
        judged = F.get(F.transform(F.array(key), lambda key: F.struct(
            level.alias("level"), _mentions(key, LORE_SECTIONS).alias("lore"),
            _mentions(key, GAMEPLAY_SECTIONS).alias("game"))), F.lit(0))
        return F.when(F.startswith(line, F.lit("==")) | F.startswith(line, F.lit("#")),
                      judged).otherwise(plain)

    state = "array<struct<cut:int,shown:boolean>>"

    def step(acc, head):
        m = head["m"]
        cut = F.coalesce(F.try_element_at(acc, F.lit(-1))["cut"], F.lit(0))
        heading = m["level"] > 0
        stays = heading & (cut > 0) & ~m["lore"] & (m["level"] > cut)
        opens = heading & ~stays & m["game"] & ~m["lore"]
        return F.concat(acc, F.array(F.struct(
            F.when(stays, cut).when(opens, m["level"]).otherwise(0).alias("cut"),
            (heading & ~opens).alias("shown"))))

    out = [c for c in df.columns]
    df = with_segments(df, column, mark)
    df = T.once(df, "states", F.aggregate("heads", F.array().cast(state), step))

    def kept(head, k):
        s = F.get("states", k)
        text = segment(F.col("lines"), F.col("heads"), k, F.when(head["m"]["level"] > 0, 1).otherwise(0))
        title = F.when(s["shown"], F.array(F.get("lines", head["at"]))).otherwise(
            F.array().cast("array<string>"))
        return F.when(s["cut"] == 0, F.concat(title, text)).otherwise(title)

    df = T.once(df, column, F.array_join(F.flatten(F.transform("heads", kept)), "\n"))
    return df.select(*out)


def reflow_headings(text: Column) -> Column:
    return _chain(text, HEADING_RULES)


def indentation(text: Column) -> Column:
    return _chain(text, INDENT_RULES)


def format_dialogue(text: Column) -> Column:
    """Bullets become quoted dialogue lines; a blank line follows each block of them."""
    shapes = F.transform(T.lines(text), lambda x: F.struct(
        x.alias("line"), T.strip(x).alias("bare")))
    shapes = F.transform(shapes, lambda r: F.struct(
        r["line"].alias("line"), (r["bare"] == "").alias("blank"),
        F.when(F.startswith(r["bare"], F.lit(BULLET)), F.regexp_replace(T.strip(F.regexp_replace(
            r["bare"], BULLET + r"|\*\*+|_+", "")), r'^"|"$', "")).alias("said")))

    def quoted(plain):
        speaker = T.strip(F.substring_index(plain, ":", 1))
        rest = T.strip(F.substring(plain, F.instr(plain, ":") + 1, F.length(plain)))
        return F.when(F.contains(plain, F.lit(":")), F.concat(
            F.lit("> **"), speaker, F.lit(":** "), F.regexp_replace(rest, r'^"|"$', ""))
        ).otherwise(F.concat(F.lit("> "), T.strip(plain)))

    # A plain line right after a bullet is preceded by one blank line.
    before = F.concat(F.array(F.lit(False)), F.transform(
        shapes, lambda r: r["said"].isNotNull()))
    rendered = F.zip_with(before, shapes, lambda after, r: F.when(
        r["said"].isNotNull(), quoted(r["said"])).when(r["blank"], None).when(
        after, F.concat(F.lit("\n"), r["line"])).otherwise(r["line"]))
    return F.array_join(rendered, "\n")


def strip_instructions(text: Column) -> Column:
    return _chain(text, INSTRUCTION_RULES)


def cut_footer(text: Column) -> Column:
    """Cut at the first footer line, unless that is the very first line."""
    rows = T.lines(text)
    flags = F.transform(rows, lambda x: F.rlike(T.strip(x), F.lit(FOOTER_LINE)))
    at = F.array_position(flags, F.lit(True))
    head = F.array_join(F.slice(rows, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")), "\n")
    return F.when(at <= 1, text).otherwise(
        F.concat(F.regexp_replace(head, r"\s+\z", ""), F.lit("\n")))


def strip_audio(text: Column) -> Column:
    """Sound file names, then lines reduced to a bare speaker or to markup."""
    # A sound file's name does not run over a line, so only lines that hold one are searched.
    rows = F.transform(T.lines(text), lambda line: F.when(
        F.rlike(line, F.lit(r"(?i)\.(?:ogg|mp3|wav)")), T.chain(line, AUDIO_RULES)).otherwise(line))

    def body(bare):
        return F.when(F.startswith(bare, F.lit(">")), T.strip(F.substring(
            bare, F.lit(2), F.length(bare)))).otherwise(bare)

    rows = F.transform(rows, lambda x: F.struct(x.alias("line"), T.let(T.strip(x), body).alias("body")))

    def says_something(r):
        body = r["body"]
        name = F.startswith(body, F.lit("**")) & F.rlike(body, F.lit(r"^\*\*[^*]*\*\*\s*:?$"))
        # A bare label: words of letters parted by one blank or hyphen, then a colon.
        label = F.endswith(body, F.lit(":")) & F.rlike(
            body, F.lit(r"^[A-Za-z][\w' -]*:$")) & ~F.rlike(
            body, F.lit(r"[ -]+[^A-Za-z: ]|[ -][ -]+[A-Za-z]|-\s*:"))
        return ~name & ~label & F.rlike(body, F.lit(r"[^>*_:.\"'–—\s-]"))

    return F.array_join(F.transform(F.filter(rows, says_something), lambda r: r["line"]), "\n")


def collapse_galleries(text: Column) -> Column:
    return T.chain_if(text, "<", GALLERY_RULES)


def collapse_blank_lines(text: Column) -> Column:
    """Removes every blank line and all leading indentation."""
    return _chain(text, BLANK_RULES)


# The cleaning chain; each group is one projection over a materialised input column.
STAGES = (
    (render_narrative, drop_noise, flatten_templates, protect_bullets, emphasis, normalise_links),
    (drop_gameplay,),
    (reflow_headings, indentation),
    (format_dialogue,),
    (strip_instructions,),
    (cut_footer,),
    (strip_audio,),
    (collapse_galleries, collapse_blank_lines, T.strip),
)


def clean_pages(df: DataFrame, column: str = "wikitext", out: str = "markdown") -> DataFrame:
    """Clean a wikitext column into Markdown, with the two reliability signals."""
    raw = strip_references(convert_tags(strip_blocks(F.col(column))))
    df = T.once(df, out, raw).withColumn("non_canon", has_non_canon(F.col(out))).withColumn(
        "canon", has_canon(F.col(out)))
    for steps in STAGES:
        if steps == (drop_gameplay,):
            df = drop_gameplay(df, out)
        else:
            df = T.once(df, out, reduce(lambda c, f: f(c), steps, F.col(out)))
    return df
