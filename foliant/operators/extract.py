"""Structured rows from page text: dialogues, records, quests, updates, announcements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import messages as M
from foliant.functions import text as T
from foliant.functions.wikitext import POINTER_LINE
from foliant.operators.chunks import heading_mark, segment, with_segments

# The three forms of a dialogue line, and the marker that ends a conversation.
BOLD_LINE = r"^>\s*\*\*([^*]+?)\*\*\s*(.*)$"
CHOICE_LINE = r"^>\s*>\s*(.+)$"
PLAIN_LINE = r"^>\s*([^:]+?)\s*:\s*(.*)$"
END_MARKER = r"(?i)[\[{(]\s*convo[\s.]+ends?\.?\s*[\s.)\]\}]"
CHAPTER_LINE = r"^##\s+(.+)$"


def page_lines(pages: DataFrame) -> DataFrame:
    """Trimmed non-empty lines with their position.  A page is one cell, so the windows
    over its lines are bounded by the size of a page."""
    rows = F.filter(F.transform(T.lines(F.col("content_markdown")), lambda x, i: F.struct(
        i.alias("at"), T.strip(x).alias("line"))), lambda r: r["line"] != "")
    return pages.select("page_id", F.inline(rows))


def parse_line(line: Column) -> dict[str, Column]:
    """Kind, speaker and text of a line by precedence: bold, choice, plain."""
    bold = F.rlike(line, F.lit(BOLD_LINE))
    choice = F.rlike(line, F.lit(CHOICE_LINE))
    plain = F.rlike(line, F.lit(PLAIN_LINE))
    label = F.regexp_extract(line, BOLD_LINE, 1)
    name = F.regexp_extract(label, r"^(.*):[^:]*$", 1)
    return {
        "form": F.when(bold, "bold").when(choice, "choice").when(plain, "plain"),
        "speaker": F.when(bold, T.strip(name)).when(choice, F.lit("")).when(
            plain, T.strip(F.regexp_extract(line, PLAIN_LINE, 1))),
        "text": F.when(bold, T.strip(F.regexp_extract(line, BOLD_LINE, 2))).when(
            choice, T.strip(F.regexp_extract(line, CHOICE_LINE, 1))).when(
            plain, T.strip(F.regexp_extract(line, PLAIN_LINE, 2))),
    }


def _accepted() -> Column:
    text, speaker = F.col("text"), F.col("speaker")
    choice = (F.col("form") == "choice") & (text != "") & ~M.is_junk(F.lit(""), text)
    spoken = ((F.col("form") != "choice") & (speaker != "") & (text != "")
              & M.is_speaker(speaker) & ~M.is_junk(speaker, text))
    return F.coalesce(choice | spoken, F.lit(False))


def dialogue_rows(pages: DataFrame) -> DataFrame:
    """Messages of each page in order, choices marked."""
    parsed = page_lines(pages).select("page_id", "at", F.inline(F.array(F.struct(*[
        c.alias(n) for n, c in parse_line(F.col("line")).items()]))))
    w = Window.partitionBy("page_id").orderBy("at")
    return parsed.filter(_accepted()).select(
        "page_id", (F.row_number().over(w) - 1).alias("message_order"), "speaker",
        F.col("text").alias("message_text"), (F.col("form") == "choice").alias("player_choice"))


def chaptered_rows(pages: DataFrame, *, skip_intro: bool) -> DataFrame:
    """Messages with their chapter and gain flag.

    The end marker credits the message it stands in, or the one before when it stands on
    a line of its own.  ``skip_intro`` drops everything before the first heading.
    """
    line = F.col("line")
    chapter = F.when(F.rlike(line, F.lit(CHAPTER_LINE)),
                     T.strip(F.regexp_extract(line, CHAPTER_LINE, 1)))
    parsed = page_lines(pages).select("page_id", "at", "line", F.inline(F.array(F.struct(
        chapter.alias("heading"), *[c.alias(n) for n, c in parse_line(line).items()],
        F.rlike(line, F.lit(END_MARKER)).alias("marked")))))
    ended = F.rlike("text", F.lit(END_MARKER))
    parsed = parsed.withColumn("own_gain", ended).withColumn(
        "text", F.when(ended, T.strip(F.regexp_replace("text", END_MARKER, ""))).otherwise(
            F.col("text")))
    parsed = parsed.withColumn("message", _accepted() & F.col("heading").isNull())
    w = Window.partitionBy("page_id").orderBy("at").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    placed = parsed.withColumn("chapter", F.last("heading", True).over(w))
    if skip_intro:
        placed = placed.filter("chapter IS NOT NULL")
    placed = placed.withColumn("message_no", F.sum(F.col("message").cast("long")).over(w))
    stray = F.col("form").isNull() & F.col("heading").isNull() & F.col("marked")
    gained = F.max(F.when(F.col("message"), F.col("own_gain")).otherwise(stray)).over(
        Window.partitionBy("page_id", "message_no"))
    return placed.withColumn("gain", gained).filter("message").select(
        "page_id", (F.col("message_no") - 1).alias("message_order"), "speaker",
        F.col("text").alias("message_text"), (F.col("form") == "choice").alias("player_choice"),
        F.col("gain").alias("chemistry_gain"), "chapter")


def context_label(title: Column, chat_prefix: str, label: str) -> Column:
    """Kind and context of a dialogue page from its title."""
    chat = F.startswith(title, F.lit(chat_prefix))
    bare = T.drop_suffix(T.drop_suffix(title, "/Quotes"), "/Transcript")
    kind = F.when(chat, "chat").when(F.endswith(title, F.lit("/Transcript")), "cinematic"
                                     ).otherwise("quote")
    return F.struct(kind.alias("kind"), F.when(chat, F.concat(
        F.lit(label), F.substring_index(title, "/", -1))).otherwise(bare).alias("context"))


# Record syntax of collectible pages.
RECORD_LINE = r"^(f)ragment\s*=\s*(.+)$"
FIELD_LINE = r"^(\|)\s*([A-Za-z]+)\s*=\s*(.*)$"
MULTILINE_KEYS = ("loretext", "hiddentext")
SERIES_LINE = r"(?m)^\s*([^|*\n]+)\|"
QUEST_REF = (r"(?i)\b(?:during|as part of|in) the\s+([\p{L}\p{N}_'&: .-]{3,80}?)\s+[Qq]uest\b")


def record_rows(pages: DataFrame) -> DataFrame:
    """Collectible records: one row per ``fragment = name`` with its fields.

    A plain line after a multi-line key extends it; other stray lines are ignored.
    """
    text = F.col("content_markdown")
    intro = F.regexp_replace(text, r"(?ms)^\s*fragment\s*=.*", "")
    base = pages.withColumn("series", T.strip(F.regexp_extract(text, SERIES_LINE, 1))).withColumn(
        "quest", F.nullif(T.strip(F.regexp_extract(intro, QUEST_REF, 1)), F.lit("")))
    marked = with_segments(base, "content_markdown", heading_mark(RECORD_LINE))
    records = F.filter(F.transform("heads", lambda h, k: F.struct(
        h["m"]["level"].alias("level"), h["m"]["title"].alias("name"),
        F.array_join(segment(F.col("lines"), F.col("heads"), k, F.lit(1)), "\n").alias("body"))),
        lambda r: r["level"] > 0)
    keep = [c for c in base.columns if c != "content_markdown"]
    rows = marked.select(*keep, F.posexplode(records).alias("record_no", "r")).select(
        *keep, "record_no", F.col("r.name").alias("item_name"), F.col("r.body").alias("body"))

    rows = with_segments(rows, "body", heading_mark(FIELD_LINE))
    first = r"^\|\s*[A-Za-z]+\s*=\s*(.*)$"
    multi = F.array(*[F.lit(k) for k in MULTILINE_KEYS])

    def field(h, k):
        key = F.regexp_extract(T.strip(F.get("lines", h["at"])), FIELD_LINE, 2)
        value = T.strip(F.regexp_extract(T.strip(F.get("lines", h["at"])), first, 1))
        more = F.filter(F.transform(segment(F.col("lines"), F.col("heads"), k, F.lit(1)), T.strip),
                        lambda x: x != "")
        whole = F.array_join(F.filter(F.concat(F.array(value), more), lambda x: x != ""), "\n")
        return F.struct(h["m"]["level"].alias("level"), key.alias("key"), F.when(
            F.array_contains(multi, key), whole).otherwise(value).alias("value"))

    rows = T.once(rows, "fields", F.filter(F.transform("heads", field), lambda f: f["level"] > 0))

    def value(name):
        return F.nullif(F.try_element_at(F.filter("fields", lambda f: f["key"] == name),
                                         F.lit(-1))["value"], F.lit(""))

    return rows.select(*keep, "record_no", "item_name", *[
        value(k).alias(a) for k, a in (("planet", "planet"), ("narrator", "narrator"),
                                       ("loretext", "item_text"), ("hiddentext", "secret_text"),
                                       ("audio", "audio"))])


# Sentences that name a quest and its release.
QUEST_SENTENCE = r"\*\*(.*?)\*\*\s+is\s+([^.,;]+?)\s+[Qq]uest\b"
RELEASE_NOTE = (r"released in\s+((?:[A-Za-z]+\s+\d+|\d+)(?:\.\d+)*(?:\s*\(\d{4}-\d{2}-\d{2}\))?)")


def quest_rows(pages: DataFrame) -> DataFrame:
    """Quest pages: name, type, release note and description; sub-pages are not quests."""
    text = F.col("content_markdown")
    quests = pages.filter(~F.contains("page_title", F.lit("/")) & F.rlike(text, F.lit(QUEST_SENTENCE)))
    words = F.split(F.lower(T.squeeze(F.regexp_extract(text, QUEST_SENTENCE, 2))), " ")
    rows = F.transform(T.lines(text), T.strip)
    begin = F.array_position(F.transform(rows, lambda x: F.startswith(x, F.lit('> "'))), F.lit(True))
    tail = F.slice(rows, F.greatest(begin, F.lit(1)).cast("int"), F.size(rows))
    stop = F.array_position(F.transform(tail, lambda x: (x == "") | F.contains(
        x, F.lit("Quest Description"))), F.lit(True))
    block = F.slice(tail, F.lit(1), F.when(stop > 0, stop - 1).otherwise(F.size(tail)).cast("int"))
    said = F.filter(F.transform(block, lambda x: T.strip(F.regexp_replace(F.regexp_replace(
        x, r"^> ", ""), r'^"+|"+$', ""))), lambda x: x != "")
    return quests.select(
        "page_id", T.strip(F.regexp_extract(text, QUEST_SENTENCE, 1)).alias("quest_name"),
        F.when(F.array_contains(words, "main"), "main").when(
            F.array_contains(words, "side"), "side").alias("quest_type"),
        F.nullif(T.strip(F.regexp_extract(text, RELEASE_NOTE, 1)), F.lit("")).alias("release_note"),
        F.when(begin > 0, F.nullif(F.array_join(said, " "), F.lit(""))).alias("quest_context"))


DATE_LINE = r"^[A-Z][a-z]{1,3}\s+\d{1,2},\s+\d{4}$"


def _first(rows: Column, test) -> Column:
    return F.get(F.filter(rows, test), F.lit(0))


def update_rows(pages: DataFrame, site_prefix: str) -> DataFrame:
    """Patch pages: version, title, type, date and first paragraph after a heading."""
    rows = pages.select("page_id", "page_title", T.clean_lines(F.col("content_markdown")).alias("rows"))
    rows = T.once(rows, "rows", F.col("rows"))
    second = F.get("rows", F.lit(1))
    is_head = F.transform("rows", lambda x: F.startswith(x, F.lit("# ")) | (
        F.startswith(x, F.lit("**")) & F.endswith(x, F.lit("**")) & (F.length(x) > 4)))
    rows = T.once(rows, "start", F.array_position(is_head, F.lit(True)).cast("int"))
    after = F.slice("rows", F.col("start") + 1, F.size("rows"))
    rows = T.once(rows, "after", F.when(F.col("start") > 0, after).otherwise(
        F.array().cast("array<string>")))

    def skipped(x):
        return F.rlike(x, F.lit("^[#-]")) | (x == "Tweet")

    lead = F.array_position(F.transform("after", lambda x: ~skipped(x)), F.lit(True)).cast("int")
    rows = T.once(rows, "after", F.when(lead > 0, F.slice("after", lead, F.size("after"))).otherwise(
        F.array().cast("array<string>")))
    stop = F.array_position(F.transform("after", skipped), F.lit(True)).cast("int")
    para = F.slice("after", F.lit(1), F.when(stop > 0, stop - 1).otherwise(F.size("after")))
    return rows.select(
        "page_id",
        F.replace(F.substring_index("page_title", "/", -1), F.lit("-"), F.lit(".")).alias("version"),
        T.strip(F.regexp_replace(F.get("rows", F.lit(0)), rf"^\Q{site_prefix}: \E", ""))
        .alias("update_title"),
        F.when(~F.rlike(second, F.lit(rf"^(#|\Q{site_prefix}\E)")), second).alias("update_type"),
        _first(F.col("rows"), lambda x: F.rlike(x, F.lit(DATE_LINE))).alias("release_date"),
        F.nullif(F.array_join(para, "\n"), F.lit("")).alias("summary"))


def announcement_rows(pages: DataFrame, site_prefix: str) -> DataFrame:
    """News pages: title, subtitle, date of publication, first real paragraph."""
    stamp = r"^Publié sur\s*([\d\-: ]+)$"
    rows = T.once(pages.select("page_id", "page_title", T.clean_lines(
        F.col("content_markdown")).alias("rows")), "rows", F.col("rows"))

    def artefact(x):
        return (F.length(x) < 2) | F.rlike(x, F.lit(
            "^(?:[#-].*|Tweet|Publié sur.*|pc|ps4|ps5|xbox|switch)$"))

    lead = F.startswith(F.get("rows", F.lit(0)), F.lit(f"{site_prefix}:"))
    real = F.filter(F.transform("rows", lambda x, i: F.struct(i.alias("at"), x.alias("x"))),
                    lambda r: ~artefact(r["x"]) & ~((r["at"] == 0) & lead))
    rows = T.once(rows, "real", real)
    published = _first(F.col("rows"), lambda x: F.rlike(x, F.lit(stamp)))
    title = F.get("real", F.lit(0))["x"]
    fallback = F.replace(F.substring_index("page_title", "/", -1), F.lit("-"), F.lit(" "))
    body = F.slice("real", F.lit(3), F.size("real"))
    return rows.select(
        "page_id", F.coalesce(title, fallback).alias("title"),
        F.get("real", F.lit(1))["x"].alias("subtitle"),
        F.nullif(T.strip(F.regexp_extract(published, stamp, 1)), F.lit("")).alias("published_at"),
        F.get(F.filter(body, lambda r: F.length(r["x"]) > 25), F.lit(0))["x"].alias("summary"))


def variant_rows(pages: DataFrame) -> DataFrame:
    """Directory pages: a base row and a Prime row, each with the line after its label."""
    rows = T.once(pages.select("page_id", "page_title", T.clean_lines(
        F.col("content_markdown")).alias("rows")), "rows", F.col("rows")).filter(F.size("rows") > 0)
    shown = T.strip(F.regexp_replace(F.get("rows", F.lit(0)), r"^[^:]*:", ""))
    rows = T.once(rows, "base", T.drop_suffix(shown, " Prime"))
    prime = F.concat("base", F.lit(" Prime"))

    def described(label):
        at = F.array_position("rows", label).cast("int")
        line = F.get("rows", at)
        return F.when((at > 0) & (F.length(line) >= 15) & (F.upper(line) != line), line)

    both = F.array(
        F.struct(F.lit(False).alias("is_prime"), described(F.col("base")).alias("description")),
        F.struct(F.lit(True).alias("is_prime"), described(prime).alias("description")))
    prime_page = F.endswith("page_title", F.lit("-prime"))
    kept = F.filter(both, lambda r: F.when(r["is_prime"], r["description"].isNotNull()).otherwise(
        ~prime_page))
    return rows.select("page_id", F.col("base").alias("frame_name"), F.inline(kept))


# --- rendering of rows for embedding: kind → (title, content) ---

DASH = " — "


def _labelled(label: str, value: Column) -> Column:
    return F.when(F.length(value) > 0, F.concat(F.lit(label), value))


def _present(value: Column) -> Column:
    return F.when(F.length(value) > 0, value)


def render_variant(r) -> tuple[Column, Column]:
    label = F.when(r["is_prime"], F.concat(r["frame_name"], F.lit(" Prime"))).otherwise(
        r["frame_name"])
    return label, F.concat_ws(". ", F.concat(F.lit("Variante: "), label), _present(r["description"]))


def render_quest(r):
    return r["quest_name"], F.concat_ws(
        DASH, F.concat(F.lit("Quête : "), r["quest_name"]), _labelled("Type : ", r["quest_type"]),
        _present(r["release_note"]), _present(r["quest_context"]))


def render_update(r):
    kind = F.when(F.length(r["update_type"]) > 0, F.concat(
        F.lit("("), r["update_type"], F.lit(")")))
    return F.concat(F.lit("Mise à jour "), r["version"]), F.concat_ws(
        DASH, F.concat(F.lit("Version "), r["version"]), _present(r["update_title"]), kind,
        _labelled("Date : ", r["release_date"]), _present(r["summary"]))


def render_announcement(r):
    return r["title"], F.concat_ws(
        DASH, F.concat(F.lit("Annonce : "), r["title"]), _present(r["subtitle"]),
        _labelled("Publié : ", r["published_at"]), _present(r["summary"]))


def render_record(r):
    title = F.concat(r["item_name"], F.lit(" ("), r["series"], F.lit(")"))
    return title, F.concat_ws(
        DASH, F.concat(F.lit("Fragment : "), r["item_name"]), F.concat(F.lit("Série : "), r["series"]),
        _labelled("Narrateur : ", r["narrator"]), _labelled("Planète : ", r["planet"]),
        F.coalesce(r["item_text"], F.lit("")), _labelled("Texte caché : ", r["secret_text"]))


def render_dialogue(r):
    kind = F.coalesce(_present(r["dialogue_kind"]), F.lit("chat"))
    context = F.coalesce(_present(r["context"]), kind)
    return F.concat_ws(DASH, context, r["speaker"]), F.concat_ws(
        " ", F.concat(F.lit("["), kind, F.lit("]")), _labelled("Chapitre : ", r["chapter"]),
        F.concat(r["speaker"], F.lit(" : "), r["message_text"]))


RENDERERS = {
    "variants": render_variant, "quests": render_quest, "updates": render_update,
    "announcements": render_announcement, "records": render_record,
    "dialogues": render_dialogue, "chat_dialogues": render_dialogue,
}


def render_rows(kind: str, rows: DataFrame, source_id: Column) -> DataFrame:
    """Structured rows of one kind as (kind, source_id, title, content)."""
    title, content = RENDERERS[kind]({c: F.col(c) for c in rows.columns})
    return rows.select(F.lit(kind).alias("kind"), source_id.alias("source_id"),
                       title.alias("title"), content.alias("content"))


def source_url(canonical: Column, base: Column, title: Column) -> Column:
    """Page URL: the canonical one, else the source base completed with the title."""
    root = F.regexp_replace(F.coalesce(base, F.lit("")), r"/+$", "")
    routed = F.startswith(title, F.lit("/"))
    key = F.when(routed, F.regexp_replace(title, r"/+$", "")).otherwise(
        F.replace(title, F.lit(" "), F.lit("_")))
    return F.when(F.length(canonical) > 0, canonical).when(
        (root == "") | (F.coalesce(title, F.lit("")) == ""), "").when(
        F.endswith(root, key), root).when(routed, F.concat(root, title)).otherwise(
        F.concat(root, F.lit("/"), key))


# --- reading view of dialogue pages ---

# Lines of wiki boilerplate that are not said by anybody.
BOILERPLATE = (
    r"(?i)^>?\s*(?:\*_SPOILERS_\*|_?:|_ |Notes:|All ending conversations|"
    r"A flow chart will be included|The corresponding flow chart|Any glowing, golden text|"
    r"Indented messages|All user input is marked|All user's choices|Rank [0-9]|_SPOILERS_|"
    r"[({\[]?\s*lines?\s+(?:required|needed|reqquired)|"
    r"[({\[]?\s*(?:same as (?:the )?below|same\s*-?\s*as\s+-?\s*above|"
    r"goes the same as below choice|jump to above branch|jump to \"|choices same as|"
    r"to next set of choices|end of conversation|continues as above|continues above))")
FOOTER = r"(?i)^(?:(?:quotesnav|quotes|sentient)$|update\s*\d+)"
SPOILER_LINE = r"(?i)^>?\s*\*_SPOILERS_\*\s*_?:\s*(.+?)_?\s*$"
SPOKEN = r"^>\s*\*\*([^*:]+):\*\*\s*(.*)$"


def reading_messages(pages: DataFrame) -> DataFrame:
    """Messages as shown to a reader, with their 1-based line number."""
    line = F.col("line")
    spoken, choice = F.rlike(line, F.lit(SPOKEN)), F.rlike(line, F.lit(CHOICE_LINE))
    quoted = F.startswith(line, F.lit("> "))
    raw = F.when(spoken, F.regexp_extract(line, SPOKEN, 2)).when(
        choice, F.regexp_extract(line, CHOICE_LINE, 1)).when(quoted, F.substring(line, F.lit(3), F.length(line)))
    text = F.regexp_replace(M.display_text(raw), r'^[ "”«»]+|[ "”«»]+$', "")
    speaker = F.when(spoken, M.display_text(F.regexp_extract(line, SPOKEN, 1))).otherwise("")
    kept = ~F.rlike(line, F.lit(BOILERPLATE)) & ~F.rlike(line, F.lit(POINTER_LINE)) & ~F.rlike(
        line, F.lit(FOOTER)) & (spoken | choice | quoted)
    rows = page_lines(pages).filter(kept).select("page_id", (F.col("at") + 1).alias("line_no"),
        F.inline(F.array(F.struct(
            F.when(spoken, "spoken").when(choice, "choice").otherwise("quote").alias("form"),
            speaker.alias("speaker"), text.alias("message_text")))))
    return rows.filter("form <> 'quote' OR message_text <> ''").withColumn(
        "player", (F.col("form") == "choice") | M.is_player(F.col("speaker")))


def page_flags(markdown: Column) -> Column:
    """Spoiler reason of the first warning, and whether the page reads like a dialogue."""
    rows = F.transform(T.lines(markdown), T.strip)
    hit = F.get(F.filter(rows, lambda x: F.rlike(x, F.lit(SPOILER_LINE))), F.lit(0))
    reason = F.regexp_replace(F.regexp_extract(hit, SPOILER_LINE, 1), r"^_+|_+$", "")
    return F.struct(
        F.when(hit.isNotNull(), F.coalesce(F.nullif(reason, F.lit("")), F.lit("Spoiler")))
        .alias("spoiler"),
        F.exists(F.slice(rows, 1, 200), lambda x: F.startswith(x, F.lit("> **"))).alias("dialogue"))


RANK_LINE = r"(?i)^#{1,3}\s+Rank\s+(\d+)\s*[-–—:]\s*(.+)$"
SECTION_LINE = r"^#{3,}\s*(.+?)\s*$"


def split_conversations(pages: DataFrame) -> DataFrame:
    """Conversations of a chat page: rank headings carry over, each section opens one.

    Ids join the page's name, the rank and the number or title; a repeated id is numbered.
    """
    def mark(line):
        bare = T.strip(line)
        rank = F.rlike(bare, F.lit(RANK_LINE))
        section = F.rlike(bare, F.lit(SECTION_LINE)) & ~rank
        return F.struct(F.when(rank, 1).when(section, 2).otherwise(0).alias("level"),
                        bare.alias("title"))

    marked = with_segments(pages, "content_markdown", mark)
    head = M.slug(T.strip(F.substring_index("page_title", "/", -1)))
    segs = F.transform("heads", lambda h, k: F.struct(
        k.alias("k"), h["m"]["level"].alias("level"), h["m"]["title"].alias("title"),
        F.array_join(segment(F.col("lines"), F.col("heads"), k, F.lit(0)), "\n").alias("body")))
    rows = marked.select("page_id", head.alias("head"), F.inline(segs))
    w = Window.partitionBy("page_id").orderBy("k").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    rank_line = F.last(F.when(F.col("level") == 1, F.col("title")), True).over(w)
    rows = rows.withColumn("rank_line", rank_line).filter("level = 2")
    n = F.regexp_extract("rank_line", RANK_LINE, 1)
    title = T.strip(F.regexp_extract("title", SECTION_LINE, 1))
    number = F.regexp_extract(title, r"(?i)^Conversation\s+(\d+)(?:[^0-9A-Za-z_]|$)", 1)
    base = F.concat(
        "head", F.when(F.length(n) > 0, F.concat(F.lit("Rank"), n)).otherwise(""),
        F.when(number != "", F.concat(F.lit("Convo"), number)).otherwise(M.slug(title)))
    rows = rows.select(
        "page_id", "k", base.alias("base"), title.alias("title"),
        F.when(F.length(n) > 0, F.concat(F.lit("Rank "), n, F.lit(" - "), T.strip(
            F.regexp_extract("rank_line", RANK_LINE, 2)))).otherwise("").alias("rank"),
        F.regexp_replace("body", r"\s+\z", "").alias("body"))
    nth = F.row_number().over(Window.partitionBy("page_id", "base").orderBy("k"))
    return rows.withColumn("nth", nth).select(
        "page_id", F.when(F.col("nth") == 1, F.col("base")).otherwise(
            F.concat_ws("-", "base", F.col("nth").cast("string"))).alias("conversation_id"),
        "title", "rank", "body")


VERSION_LINE = (r"^(?:\*\*)?(?:\d+(?:\.\d+){0,3}|(?:Update|Hotfix|Mainline|Revised)\s+\d+(?:\.\d+){0,3}|"
                r"Vanilla|Prime Vault)(?:\*\*)?\s*$")


def version_notes(pages: DataFrame) -> DataFrame:
    """Notes of the Patch History section, one row per version that has any."""
    text = F.col("content_markdown")
    section = F.regexp_extract(
        F.concat(text, F.lit("\n# ")), r"(?ms)^#{2,4}\s*Patch History[ \t]*$(.*?)(?=^#{1,2}\s)", 1)
    base = T.once(pages.select("page_id", section.alias("section")).filter("section <> ''"),
                  "section", F.col("section"))

    def mark(line):
        bare = T.strip(line)
        return F.struct(F.when(F.rlike(bare, F.lit(VERSION_LINE)), 1).otherwise(0).alias("level"),
                        F.regexp_replace(bare, r"^\*+|\*+$", "").alias("title"))

    marked = with_segments(base, "section", mark)

    def note(x):
        return T.strip(T.chain(T.strip(x), (
            (r"^\[.*\]$", ""), (r"^[>*]\s*", ""), (r"^-\s+", ""), (r"\{[^{}\n]{0,160}\}", ""))))

    groups = F.transform("heads", lambda h, k: F.struct(
        h["m"]["level"].alias("level"), h["m"]["title"].alias("version"),
        F.filter(F.transform(segment(F.col("lines"), F.col("heads"), k, F.lit(1)), note),
                 lambda x: x != "").alias("notes")))
    rows = marked.select("page_id", F.posexplode(groups).alias("version_no", "g"))
    return rows.filter("g.level > 0 AND size(g.notes) > 0").select(
        "page_id", "version_no", "g.version", "g.notes")


def without_version_notes(text: Column) -> Column:
    """Page text before its Patch History section."""
    head = F.regexp_replace(text, r"(?ms)^#{2,4}\s*Patch History[ \t]*$.*\z", "")
    return F.when(F.rlike(text, F.lit(r"(?m)^#{2,4}\s*Patch History[ \t]*$")), F.concat(
        F.regexp_replace(head, r"\s+\z", ""), F.lit("\n"))).otherwise(text)
