"""HTML extraction by consensus host paths.

A page is read as a list of text blocks, each with the path of containers above it.  Paths are
generalised: tag and class names, digits levelled, positions dropped.  On every page the
containers are scored by the text that stands in them, links discounted.  The tightest one that
holds most of the page's text, widened to the article or main element around it, else to the
parents in which more text stands beside it, is the page's candidate.  Spark counts the candidates of each host and the path with the most votes wins.  The
text of a page is what stands under its host's winning path if that is enough of the page's own
text, else what stands under its own candidate; blocks outside the winning path that other pages
of the host repeat are not a page's own.  Pages without a host are read by their own candidates.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.skew import lookup_join
from foliant.session import materialize

MOST = 0.6  # share of the page's text that a candidate holds
PROSE = 80  # characters from which a block is text without the end of a sentence
ENOUGH = 0.4  # share of the page's own text that the host's winning path holds

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)", re.DOTALL)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_DIGITS = re.compile(r"\d+")
_PARTS = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SENTENCE = re.compile(r"[.!?…。！？][\"'»”’)\]]*\Z")

# Elements whose content is not text, elements without content, and elements that break lines.
RAW = frozenset("script style textarea title noscript template iframe noembed xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main "
    "menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead "
    "tr ul".split())
# Elements that are no part of an article's text, wherever they stand.
ASIDE = frozenset(
    "nav header footer aside form script style head button select menu dialog svg canvas object "
    "audio video textarea title noscript template iframe noembed xmp search".split())
# A class, id or role says that a container is none either, if it is one of these words or a
# compound with such a word last ("site-footer") or of such words and places ("ad-slot").
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs "
    "consent contentinfo cookie cookies copyright footer footnav form gdpr header "
    "legal login masthead menu menubar modal nav navbar navigation newsletter notice notices "
    "outbrain overlay pager pagination paywall popup promo promoted promotion recommended related "
    "search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription taboola toolbar topbar widget widgets".split())
READERS = frozenset("comment comments disqus replies reply respond".split())
PLACES = frozenset(
    "area bar block body bottom box buttons card container content icons inner item items left "
    "link links list main outer page panel posts right row section side site slot text top unit "
    "user users wrap wrapper zone".split())
# First words of names that tell a state or a topic and not what a container is.
STATES = frozenset("has no with without is not hide show category cat tag topic format type status "
                   "page post".split())
NONE, WEAK, STRONG, CERTAIN = range(4)  # what the names of a container say against it
# Elements that an opening tag of the set ends, if open, up to the nearest of the stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
SCOPE = frozenset("article section div td th table body html main aside nav header footer".split())

# Elements of an article's text that need no container of their own.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dd dt pre blockquote table tbody tr td th".split())

# Names of grid columns: what stands beside such a container is another column.
COLUMNS = frozenset("col column columns cell grid".split())

Block = tuple[tuple[str, ...], str, int]  # containers above, text, characters in links


def _evidence(name: str) -> int:
    """What one class, id or role says against a container."""
    parts = _PARTS.findall(_HUMP.sub("-", name).lower())
    known = [p in WORDS or p in READERS for p in parts]
    if not any(known):
        return NONE
    whole = parts[0] not in STATES or len(parts) == 1
    if whole and (known[-1] or all(k or p in PLACES for k, p in zip(known, parts))):
        return CERTAIN if READERS & set(parts) else STRONG
    return WEAK


@functools.lru_cache(4096)
def _step(tag: str, attrs: str) -> tuple[str, int]:
    """(generalised step of a path, what the container's names say against it)."""
    found = {k.lower(): entities.unescape(v.strip("\"'")) for k, v in _NAMES.findall(attrs)}
    names = " ".join(found.values()).split()
    classes = sorted({_DIGITS.sub("#", c) for c in found.get("class", "").lower().split()})
    against = max(map(_evidence, names), default=NONE)
    return ".".join([tag, *classes]), NONE if tag in (
        "html", "body", "main", "article") else against


def _shown(found: list[tuple[Block, tuple[int, ...]]], against: list[int]) -> list[Block]:
    """Blocks without those in containers that their names and scores rule out.

    A container that holds mostly links goes on any evidence, others on strong evidence.  One with
    most of the text of a page without an article or main element stays, unless it is of readers,
    if it holds three paragraphs.
    """
    if not against:
        return [block for block, _ in found]
    free, linked, paragraphs = [[0] * len(against) for _ in range(3)]
    total, marked = 0, False
    for (path, text, links), above in found:
        total += len(text) - links
        marked = marked or any(s.split(".")[0] in ("article", "main") for s in path)
        for k in above:
            free[k] += len(text) - links
            linked[k] += links
            paragraphs[k] += path[-1].split(".")[0] == "p"
    gone = set()
    for k, says in enumerate(against):
        if linked[k] > free[k] or says == CERTAIN:
            gone.add(k)
        elif says == STRONG and (marked or free[k] < MOST * total or paragraphs[k] < 3):
            gone.add(k)
    return [block for block, above in found if not gone.intersection(above)]


def blocks(html: str | None) -> list[Block]:
    """Text blocks of a page in order, without what is no part of any article.

    Character references are decoded and white space inside a block is one space.  Tags that are
    missing, crossed or never closed are tolerated.
    """
    out: list[tuple[Block, tuple[int, ...]]] = []
    text: list[str] = []
    linked = 0
    against: list[int] = []  # of each container with evidence against it
    # tag, step, aside here or above, containers with evidence here or above
    stack: list[tuple[str, str, bool, tuple[int, ...]]] = []
    links = 0

    def flush() -> None:
        nonlocal linked
        if text:
            # A line break is white space; each piece was decoded on its own.
            joined = " ".join("".join(text).split())
            if joined:
                block = tuple(s for _, s, _, _ in stack), joined, min(linked, len(joined))
                out.append((block, stack[-1][3] if stack else ()))
            text.clear()
            linked = 0

    def close(at: int) -> None:
        flush()
        del stack[at:]

    source, at, stop = html or "", 0, len(html or "")
    while at < stop:
        token = _TOKEN.match(source, at)
        at = token.end()
        piece = token["text"]
        if piece is not None:
            if not (stack and stack[-1][2]):
                decoded = entities.unescape(piece)
                text.append(decoded)
                if links:
                    linked += len(decoded.strip())
            continue
        tag = (token["tag"] or "").lower()
        if not tag:
            continue
        if token["end"]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag == "br":
                text.append(" ")
            elif tag in BLOCK or tag in ASIDE:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        close(k)
                        links = 0
                        break
                    if tag == "p" and stack[k][0] in SCOPE:
                        break
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}\\b[^>]*>?", re.IGNORECASE).search(source, at)
            at = end.end() if end else stop
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                text.append(" " if tag == "br" else "")
            continue
        if tag == "a":
            links += 1
            continue
        if tag not in BLOCK and tag not in ASIDE:
            continue  # inline
        for k in range(len(stack) - 1, -1, -1):  # a paragraph ends where a block begins
            if stack[k][0] == "p":
                close(k)
                break
            if stack[k][0] in SCOPE:
                break
        if tag in ENDS:
            ended, stops = ENDS[tag]
            cut = None
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in stops:
                    break
                if stack[k][0] in ended:
                    cut = k
            if cut is not None:
                close(cut)
        flush()
        step, says = _step(tag, token["attrs"] or "")
        aside, above = (stack[-1][2], stack[-1][3]) if stack else (False, ())
        if says:
            above += (len(against),)
            against.append(says)
        stack.append((tag, step, aside or tag in ASIDE, above))
    flush()
    return _shown(out, against)


def candidate(found: list[Block], most: float = MOST) -> tuple[str, ...]:
    """Path of the tightest container that holds ``most`` of the page's text; () without text.

    A block counts by its characters outside links.  A container of one block (a paragraph, a
    heading) is no candidate unless nothing above it holds more.
    """
    weight = [len(text) - linked for _, text, linked in found]
    total = sum(weight)
    if not total:
        weight = [len(text) for _, text, _ in found]
        total = sum(weight)
    held: dict[tuple[str, ...], int] = {}
    for (path, _, _), w in zip(found, weight):
        for depth in range(len(path) + 1):
            held[path[:depth]] = held.get(path[:depth], 0) + w
    leaves = {path for path, _, _ in found if path and path[-1].split(".")[0] in (
        "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote", "dd", "dt", "td")}
    best: tuple[str, ...] = ()
    for path, w in held.items():
        if w >= most * total and len(path) > len(best) and path not in leaves:
            best = path
    for name in ("article", "main"):
        for depth in range(len(best), 0, -1):
            if best[depth - 1].split(".")[0] == name:
                return best[:depth]
    # What stands beside it belongs to it: paragraphs and headings without a container of their
    # own, and below the body also containers with text.
    at = best
    for depth in range(len(best) - 1, -1, -1):
        beside = [b for b, w in zip(found, weight)
                  if w and b[0][:depth] == best[:depth] and b[0][:len(at)] != at]
        closed = depth == 0 or best[depth - 1].split(".")[0] in ("body", "html")
        column = bool(at) and not COLUMNS.isdisjoint(_PARTS.findall(at[-1]))
        if any(2 * linked <= len(text) and (
                all(step.split(".")[0] in LEAVES for step in path[depth:])
                or not closed and not column and (len(text) >= PROSE or _SENTENCE.search(text)))
               for path, text, linked in beside):
            at = best[:depth]
    return at


def read_text(found: list[Block], path: tuple[str, ...]) -> str:
    """Blocks under a path, joined by line ends."""
    return "\n".join(text for above, text, _ in found if above[:len(path)] == path)


def own_text(found: list[Block], winner: tuple[str, ...] | None, repeated: set[int]) -> str:
    """The page's text by the winning path, or by its own candidate, for which repeated blocks
    do not count."""
    if winner is None:
        return read_text(found, candidate(found))
    inside = [b for b in found if b[0][:len(winner)] == winner]
    own = [b for b in found if b[0][:len(winner)] == winner or _print(b[1]) not in repeated]
    held, total = _unlinked(inside), _unlinked(own)
    if inside and held >= ENOUGH * total:
        return read_text(found, winner)
    return read_text(found, candidate(own or found))


def _unlinked(found: list[Block]) -> int:
    return sum(len(text) - linked for _, text, linked in found)


def _print(text: str) -> int:
    """A hash of a block's text, as a signed long."""
    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user, port or a leading ``www.``; empty if there is none."""
    rest = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[a-zA-Z][\w+.-]*://"
                            r"(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(rest), r"^www\.", "")


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = [blocks(h.as_py()) for h in batch.column(1)]
        paths = [candidate(found) if found else None for found in pages]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(paths, pa.list_(pa.string()))], ["host", "path"])


def _outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page, host, html, path) -> (page, host, block, disputed) of blocks not under the path."""
    for batch in batches:
        out = []
        for page, host, source, path in zip(*(c.to_pylist() for c in batch.columns)):
            found, winner = blocks(source), tuple(path)
            rest = [b for b in found if b[0][:len(winner)] != winner]
            total = _unlinked(found)
            disputed = total - _unlinked(rest) < ENOUGH * total or len(rest) == len(found)
            out += [(page, host, k, disputed) for k in {_print(text) for _, text, _ in rest}]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], kind) for i, kind in enumerate(
                (pa.int64(), pa.string(), pa.int64(), pa.bool_()))],
            ["page", "host", "block", "disputed"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [own_text(blocks(page), None if path is None else tuple(path), set(again or ()))
                 for page, path, again in zip(*(c.to_pylist() for c in batch.columns[2:]))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path, votes): the winning path of every host, ties to the first by name.

    An empty path is the page as a whole.
    """
    votes = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias(
        "html")).filter("host <> ''").mapInArrow(_vote, "host string, path array<string>").filter("path is not null")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("votes"))
    return counted.groupBy("host").agg(
        F.min(F.struct((-F.col("votes")).alias("less"), "path")).alias("won")).select(
        "host", "won.path", (-F.col("won.less")).alias("votes"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    A null or blank page has an empty text, and so has a page without text of its own.  Pages
    whose URL is null or names no host do not vote.  Repeated rows each vote and each give a
    row; page_id may be null; an empty table gives an empty result.  Other columns are not read.
    """
    winners = materialize(host_paths(pages)).select("host", "path")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    rows = rows.withColumn("page", F.xxhash64("host", "html"))
    joined = lookup_join(rows, winners, ["host"], F.xxhash64("page_id", "url"), "left")
    outside = materialize(joined.filter("path is not null and html is not null").select(
        "page", "host", "html", "path").mapInArrow(
        _outside, "page long, host string, block long, disputed boolean"))
    repeated = outside.groupBy("host", "block").agg(
        F.min("page").alias("least"), F.max("page").alias("most")).filter("least <> most")
    again = outside.filter("disputed").join(repeated, ["host", "block"]).groupBy("page").agg(
        F.collect_set("block").alias("again"))
    read = lookup_join(joined, again, ["page"], F.xxhash64("page_id", "url"), "left")
    return read.select("page_id", "url", "html", "path", "again").mapInArrow(
        _read, "page_id long, url string, text string, n_chars long")
