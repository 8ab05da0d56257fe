"""Extraction: hand-worked pages, planted articles on generated hosts, the given pages."""

import html
import re

import numpy as np
import pytest

from foliant.llm import host_paths as h

SF = "/root/testdata/sf0.01"

CASES = {
    # unclosed paragraphs and inline tags, references, white space
    "<html><body><article><h1>T &amp; U</h1><p>one\n two<p><b>three<br>four<p>five</article>":
        "T & U\none two\nthree four\nfive",
    # scripts, styles, comments and quoted ends
    "<body><main><script>var a='</p><p>no';</script><style>p{}</style><!-- <p>no</p> -->"
    "<p title='a > b'>yes</p><p>and&nbsp;more &#233;&lt;p&gt;</p></main></body>":
        "yes\nand more é<p>",
    # furniture by tag and by class
    "<body><header>no</header><nav><ul><li>no</ul></nav><div class='page'><div class='post-12'>"
    "<h2>Head</h2><p>A long enough text stands here.</p><div class='ad'>buy</div>"
    "<ul><li>first<li>second</ul></div><div id=comments><p>reader</p></div>"
    "<div class='side-bar sidebar'>no</div></div><form><p>no</p></form><footer>no</footer></body>":
        "Head\nA long enough text stands here.\nfirst\nsecond",
    # a word inside a word is no reason
    "<body><div class='heading adapt'><p>download the shadow</p></div></body>":
        "download the shadow",
    # nothing but text, an open comment, a lone sign
    "plain text only": "plain text only",
    "a < b and c": "a < b and c",
    "<p>x</p><!-- open": "x",
    "": "", "   \n": "", "<html><body></body></html>": "",
    "<body><table><tr><td>a<td>b<tr><td>c</table></body>": "a\nb\nc",
}


@pytest.mark.parametrize("page", CASES)
def test_pages(page):
    found = h.blocks(page)
    assert h.read_text(found, h.candidate(found)) == CASES[page]


def test_long_pages():
    page = "<body><div>" + "<p>word " * 50_000 + "</div>"
    assert h.read_text(h.blocks(page), ()) == "\n".join(["word"] * 50_000)
    deep = "<div>" * 300 + "<p>deep</p>"
    assert h.read_text(h.blocks(deep), ()) == "deep"


def _host_pages(rng, host, n):
    """Pages of a host that wraps its articles in containers of its own; (url, html, text)."""
    tag, cls = rng.choice(["div", "section", "main"]), f"box{rng.integers(100)}"
    out = []
    for i in range(n):
        lines = [" ".join(f"w{x}" for x in rng.integers(0, 500, int(rng.integers(5, 40))))
                 for _ in range(int(rng.integers(2, 9)))]
        body = "".join(f"<p>{html.escape(x)} &amp; é</p>" for x in lines)
        text = "\n".join(x + " & é" for x in lines)
        # A long unmarked column next to the article on every fourth page.
        column = f"<div class='col'><p>{'aside ' * 400}</p></div>" if i % 4 == 3 else ""
        out.append((f"https://{host}/p/{i}",
                    f"<html><body><nav>menu</nav>{column}<{tag} class='{cls} post-{i}'>{body}"
                    f"</{tag}><div class='cookie-notice'>ok</div><footer>f</footer></body></html>",
                    text))
    return out


def test_hosts_agree_on_a_path(spark):
    rng = np.random.default_rng(4)
    rows = [r for k in range(6) for r in _host_pages(rng, f"h{k}.example.org", 12)]
    rows += [(None, "<article><p>no host</p></article>", "no host"),
             (None, None, ""), ("https://h0.example.org/odd", "<b>other</b> form", "other form")]
    rows.append(rows[0])
    df = spark.createDataFrame(
        [(i if i else None, u, x, 1, "t") for i, (u, x, _) in enumerate(rows)],
        "page_id long, url string, html string, n_chars int, text string").repartition(3)
    out = h.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = {r.page_id: r for r in out.collect()}
    assert len(got) == len(rows)
    for i, (url, _, text) in enumerate(rows):
        r = got[i if i else None]
        assert (r.url, r.text, r.n_chars) == (url, text, len(text))
    # Alone, a page with the column would have chosen differently.
    alone = h.blocks(rows[3][1])
    assert h.read_text(alone, h.candidate(alone)) != rows[3][2]
    assert h.extract(df.limit(0)).count() == 0


def test_given_pages(spark):
    """The given pages hold their article in <article>; read it with patterns only."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.DOTALL)[1]
        parts = re.split(r"</?(?:p|h1)>", inner)
        lines = [" ".join(html.unescape(re.sub(r"<(?:/?b|br)>", " ", x)).split()) for x in parts]
        want[r.page_id] = "\n".join(x for x in lines if x)
    got = {r.page_id: r.text for r in h.extract(pages).collect()}
    assert got == want


def test_host_names(spark):
    df = spark.createDataFrame([(u,) for u in (
        "https://WWW.Ex.org:80/a", "http://u:p@ex.org?q", "ftp://a.b", "no url", None, "")],
        "url string")
    assert [r[0] for r in df.select(h.host_of(df.url)).collect()] == [
        "ex.org", "ex.org", "a.b", "", "", ""]


def test_a_class_may_hold_a_slash(spark):
    page = "<body><div class='w-1/2'><p>text of the page</p></div></body>"
    df = spark.createDataFrame([("http://a.org/1", page)], "url string, html string")
    assert [tuple(r.path) for r in h.host_paths(df).collect()] == [("body", "div.w-#/#")]


def _prose(rng, n):
    return " ".join(f"w{x}" for x in rng.integers(0, 10_000, n))


def test_pages_of_another_template_are_read_whole(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for i in range(9):
        head, body = _prose(rng, 12), _prose(rng, 80)
        if i % 3:  # the article is in content
            page, text = f"<div class='content'><p>{head}</p><p>{body}</p></div>", f"{head}\n{body}"
        else:  # content has a teaser only
            page, text = (f"<div class='content'><p>{head}</p></div><div class='body'><p>{body}"
                          "</p></div>"), body
        rows.append((i, "https://two.example.org/", f"<body>{page}</body>"))
        want[i] = text
    # Pages without a host have nothing to do with each other.
    for i in range(10, 16):
        body = _prose(rng, 40)
        tag = "content" if i < 14 else "body"
        teaser = "" if i < 14 else "<div class='content'><p>teaser</p></div>"
        rows.append((i, None, f"<body>{teaser}<div class='{tag}'><p>{body}</p></div></body>"))
        want[i] = body
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r.page_id: r.text for r in h.extract(df).collect()} == want


def test_the_root_votes(spark):
    rows = [(f"http://r.org/{i}", f"<p>one {i}</p><p>two</p>") for i in range(3)]
    rows.append(("http://r.org/x", "<div class='d'><p>three</p><p>four</p></div>"))
    df = spark.createDataFrame(rows, "url string, html string")
    assert [(tuple(r.path), r.votes) for r in h.host_paths(df).collect()] == [((), 3)]


def test_candidates_take_the_text_beside_them():
    page = ("<body><div class='page'><h1>Title</h1><p>An introduction of some words.</p><ul>"
            + "<li>item with a few words in it</li>" * 5 + "</ul></div><div class='col'><p>other"
            "</p></div></body>")
    found = h.blocks(page)
    assert h.candidate(found) == ("body", "div.page")
    page = page.replace("<ul>", "<section>").replace("</ul>", "</section>").replace("li>", "p>")
    assert h.candidate(h.blocks(page)) == ("body", "div.page")


LAYOUTS = [
    "<article><div class='lead'>{}</div><div class='text'>{}</div></article>",
    "<div class='post'><div class='intro'>{}</div><div class='text'>{}</div></div>",
    "<main><section>{}</section><div>{}</div></main>",
    "<div class='post has-header'>{}{}</div>",
    "<div class='legal-news'>{}{}</div>",
    "<div class='entry social-science'>{}{}</div>",
    "<div id='share-of-market'>{}{}</div>",
    "<div class='post category-legal'>{}{}</div>",
    "<div class='notice'>{}{}</div>",
]
FURNITURE = ("<div class='cookie-notice'><p>We use cookies.</p></div><div class='siteFooter'>All "
             "rights reserved.</div><div id='ad-slot-3'><p>Buy now!</p></div><div class='user-comments'>"
             "<p>A reader says something.</p><p>So does another one.</p><p>And a third.</p></div>"
             "<div class='social-icons'>Share.</div><div class='top-links'><a href='/'>Home</a></div>")


@pytest.mark.parametrize("layout", LAYOUTS)
def test_whole_articles(spark, layout):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for i in range(6):
        lead, body = [_prose(rng, 30) + "."], [_prose(rng, 35) + "." for _ in range(2)]
        page = layout.format(*("".join(f"<p>{x}</p>" for x in part) for part in (lead, body)))
        rows.append((i, "https://whole.org/", f"<body><nav>menu</nav>{page}{FURNITURE}</body>"))
        want[i] = "\n".join(lead + body)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in h.extract(df).collect()} == want


def test_names_against_a_container():
    for name, says in {"ad": h.STRONG, "site-footer": h.STRONG, "ad_slot_12": h.STRONG,
                       "userComments": h.CERTAIN, "comment-list": h.CERTAIN, "has-header": h.WEAK,
                       "legal-news": h.WEAK, "social-science": h.WEAK, "share-of-market": h.WEAK,
                       "tag-legal": h.WEAK, "research": h.NONE, "": h.NONE, "w-1/2": h.NONE,
                       "shadow": h.NONE, "content": h.NONE}.items():
        assert h._evidence(name) == says, name
    # Weak evidence counts against links only, and an advert beside a short article is none.
    page = ("<body><div class='x'><p>Head of it</p><div class='legal-news'><a href=1>one link</a>"
            "</div></div><div class='ad'>" + "Buy this now. " * 30 + "</div></body>")
    found = h.blocks(page)
    assert h.read_text(found, h.candidate(found)) == "Head of it"


def test_grid_columns_stay_apart():
    page = ("<body><div class='row'><div class='col-md-8'><p>" + "The article goes on. " * 20
            + "</p></div><div class='col-md-4'><p>Another column with some text.</p></div></div>")
    found = h.blocks(page)
    assert h.candidate(found)[-1] == "div.col-md-#" and len(h.candidate(found)) == 3


def test_passages_that_other_pages_repeat_stay(spark):
    """A page outside the winning template keeps a passage that it shares with another page."""
    rng = np.random.default_rng(9)
    shared, rows, want = _prose(rng, 60), [], {}
    for i in range(8):
        own = _prose(rng, 70)
        name = "content" if i < 6 else "other"
        rows.append((i, "http://s.org/", f"<body><div class='{name}'><p>{own}</p><p>{shared}</p>"
                     "</div></body>"))
        want[i] = f"{own}\n{shared}"
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in h.extract(df).collect()} == want
