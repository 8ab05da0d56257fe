"""Golden cases of the text functions and of the cleaning chain."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.functions import classify as C
from foliant.functions import html as H
from foliant.functions import messages as M
from foliant.functions import text as T
from foliant.functions import wikitext as X
from foliant.functions.paging import cut_pages
from foliant.operators import chunks


def one(spark, fn, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(fn(*[F.col(n) for n in names]).alias("v")).collect()[0].v


@pytest.mark.parametrize("fn, given, want", [
    (T.fold_leet, "l3t71e", "lettle"),
    (T.sanitize_filename, "/Lotus/A b.png!00_x/y", "y"),
    (T.sanitize_filename, "/Lotus/A b.png!00_xy", "A_b.png__00_xy"),
    (T.sanitize_filename, "/Lotus/Plain.png", "Plain.png"),
    (T.drop_suffix, "Brann (fr)", "Brann"),
    (T.drop_suffix, "Brann", "Brann"),
    (T.strip_context_prefix, "Page: A | Section: B - C - text", "C - text"),
    (T.strip_context_prefix, "Page: A - text", "text"),
    (T.strip_padding, "mot**", "mot**"),
    (T.strip_padding, "mot *", "mot"),
    (T.strip_padding, "mot ---  ", "mot"),
    (T.rank_label, "GastonRank3Convo1", "Rank 3"),
    (T.rank_label, "Gaston", ""),
    (M.display_text, "Hi {If x}you {P2}there {Continues below}", "Hi you there"),
    (M.display_text, "End {Convo. Ends. Jump}", "End {Convo. Ends. Jump}"),
    (M.script_ref, "> Ah {P1} Well!?", "ah well"),
    (M.graph_ref, "**Hello  There** {Convo. ends.}", "hello there"),
])
def test_scalars(spark, fn, given, want):
    assert one(spark, fn, given) == want


def test_lexeme_forms(spark):
    assert set(one(spark, T.lexeme_forms, "énergétiques")) >= {
        "énergétiques", "énergétiqu", "energetique", "energetic", "énergétic"}


def test_ids_are_crc_based_and_disjoint(spark):
    import zlib
    fr, en = one(spark, T.route_id, "/a"), one(spark, lambda c: T.route_id(c, "en"), "/a")
    assert fr == zlib.crc32(b"fr:/a") & 0x7FFFFFFF
    assert en == (1 << 31) | (zlib.crc32(b"en:/a") & 0x3FFFFFFF)
    assert one(spark, T.mirror_id, "A") == (3 << 30) | (zlib.crc32(b"frwiki:A") & 0x3FFFFFFF)


def test_snippet(spark):
    text = "x" * 100 + " needle **bold** {skip} " + "y" * 100
    got = one(spark, lambda c: T.snippet(c, F.lit("needle"), 20), text)
    assert got.startswith("…") and got.endswith("…") and "needle bold" in got and "skip" not in got
    assert one(spark, lambda c: T.snippet(c, F.lit("zzz"), 20), "short") == "short"


def test_name_citation(spark):
    def cited(text, name):
        return one(spark, lambda t, n: T.cites_name(t, T.name_variants(n)), text, name)

    assert cited("hé marlo !", "MarloDels") and cited("DELS?", "MarloDels")
    assert not cited("marlonque", "MarloDels")


def test_replace_first_and_mentions(spark):
    assert one(spark, lambda c: T.replace_first(c, F.lit("THE"), F.lit("a")), "see The the") == "see a the"
    assert one(spark, lambda c: T.replace_mentions(c, F.create_map(F.lit("7"), F.lit("Ana"))),
               "<@7> and <@!7> not <@8>") == "Ana and Ana not <@8>"


def test_pages_concatenate_to_the_source():
    text = ("word " * 30 + "x" * 50 + "\nline ") * 9
    for limit in (7, 40, 64):
        pages = cut_pages(text, limit)
        assert "".join(pages) == text and max(map(len, pages)) <= limit
    assert cut_pages("ab cd", 4) == ["ab ", "cd"]


def test_html_to_markdown():
    html = ("<html><body><nav>menu<ul><li>x</li></ul></nav><h1>Title</h1><p>One <b>two</b> <em>three"
            "</em><br>four</p><video><source src=a><p>after video</p><ul><li>a</li><li>b</li></ul>"
            "<script>var x='<p>no</p>';</script><footer>foot</footer></body></html>")
    assert H.page_to_markdown(html) == "\n".join([
        "# Title", "One **two***three*", "four", "after video", "- a", "- b"])


@pytest.mark.parametrize("href, want", [
    ("/fr/a?x=1#t", "/fr/a"), ("https://H.example/fr/b/", "/fr/b"), ("https://other.example/fr", None),
    ("//cdn/x", None), ("mailto:x", None), ("/fr/x.png", None), ("/fr/forum/1", None), ("rel", None),
    ("/", "/")])
def test_link_path(spark, href, want):
    prefix = "/" if href == "/" else "/fr"
    assert one(spark, lambda c: H.link_path(c, F.lit("h.example"), prefix, ("forum",)), href) == want


WIKI = """<!-- note -->{{Infobox|a=b}}{{Quote|Hear me|Teodor}}
'''Bold''' and ''it'' with [[File:x.png|thumb]] [[Page#s|label]] [[Help:Target#x]] [https://e.org site]
== Acquisition ==
Buy it.
=== Deep ===
hidden text
== Lore ==
* Brann: "Operator?"
* Plain bullet
After.
{{Speculation|maybe}}
{{Custom|first|second}}
Update 27.2
tail"""


def test_cleaning_chain(spark):
    df = spark.createDataFrame([(1, WIKI)], "page_id int, wikitext string")
    row = X.clean_pages(df).collect()[0]
    assert row.non_canon and not row.canon
    assert row.markdown.split("\n") == [
        '> "Hear me"', "> — Teodor",
        "**Bold** and _it_ with  label Target site", "## Deep", "## Lore",
        "> **Brann:** Operator?", "> Plain bullet", "After.",
        "> **[NON-CANON / SPECULATION JOUEUR]** maybe", "first|second"]


def test_gameplay_block_ends_at_lore_or_same_level(spark):
    text = "intro\n== Stats ==\na\n=== Deeper ===\nb\n== Tips ==\nc\n==== History ====\nkept\n== End ==\nz"
    df = spark.createDataFrame([(text,)], "t string")
    assert X.drop_gameplay(df, "t").collect()[0].t.split("\n") == [
        "intro", "=== Deeper ===", "==== History ====", "kept", "== End ==", "z"]


@pytest.mark.parametrize("given, want", [
    ("a {Same as below} b", "a  b"), ("a {Convo ends. Same} b", "a {Convo ends. Same} b"),
    ("> **{If shy} Gaston:** hi", "> **Gaston:** hi"), ("x {P12}\ny", "x\ny")])
def test_instructions(spark, given, want):
    assert one(spark, X.strip_instructions, given) == want


def test_footer_and_audio(spark):
    assert one(spark, X.cut_footer, "a\n\nquotesnav\nb") == "a\n"
    assert one(spark, X.cut_footer, "Sentient\nb") == "Sentient\nb"
    assert one(spark, X.strip_audio, "> **Ana:** clip_1.ogg\n> **Ana:** hi a.mp3\nBare label:\n---\nok") \
        == "> **Ana:** hi \nok"


def test_splitter_invariants(spark):
    def split(text, size, lap):
        return one(spark, lambda c: chunks.split_column(c, size, lap), text)

    text = "\n\n".join("Sentence one. " * n + "word " * n for n in range(1, 60))
    parts = split(text, 200, 30)
    assert max(map(len, parts)) <= 200 and all(p.strip() for p in parts)
    plain = split(text, 200, 0)
    assert "".join(plain).split() == text.split()
    assert split("x" * 25, 10, 4) == ["x" * 10, "x" * 10, "x" * 10, "x" * 7, "x"]
    assert split("aa bb cc dd", 5, 2) == ["aa ", "a bb ", "cc dd"]
    assert split("\u00a0 aa \u2003", 5, 2) == ["aa"] == split("aa", 5, 2)


def test_overlap_and_hard_pieces(spark):
    got = one(spark, lambda c: chunks.overlap(F.split(c, ","), 6, 3), "abcd,efgh,ghij,123456")
    assert got == ["abcd", "cdefgh", "ghghij", "123456"]
    assert one(spark, lambda c: chunks.hard_pieces(c, 4, 1), "abcdefgh") == ["abcd", "defg", "gh"]
    assert one(spark, lambda c: chunks.hard_pieces(c, 4, 4), "abcdef") == ["abcd", "ef"]


def test_chunk_pages(spark):
    md = "lead\n# Top\ntext\n## A\n### B\ninside\n## C\n" + "long sentence. " * 20
    df = spark.createDataFrame([(1, "T", md)], "page_id int, page_title string, content_markdown string")
    rows = chunks.chunk_pages(df, 120, 20).orderBy("chunk_index").collect()
    assert [r.section for r in rows][:3] == ["", "", "A > B"] and rows[3].section == "C"
    assert rows[2].content_markdown == "Page: T | Section: A > B - inside"
    assert rows[2].metadata == {"Header 1": "Top", "Header 2": "A", "Header 3": "B", "page_title": "T",
                                "section": "A > B"}
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    back = chunks.section_records(chunks.chunk_pages(df, 120, 20)).orderBy("chunk_index").collect()
    assert back[2].body == "inside" and all(len(r.body) <= 120 for r in back)


def test_merged_sections(spark):
    def run(text):
        df = spark.createDataFrame([(1, text)], "page_id int, t string")
        return [(r.section_title, r.content) for r in chunks.merged_sections(df, "t", 10).collect()]

    assert run("short\n## A\nlong enough text\n### B\ntiny\n#### keep\n## C\nanother long one") == [
        ("A", "long enough text"),
        ("B", "tiny #### keep"), ("C", "another long one")]
    assert run("lead that is long\n## A\nx\n## B\ny") == [("Introduction", "lead that is long x y")]
    assert run("tiny") == []


@pytest.mark.parametrize("text, entity", [
    ("Qui est Aldwin ?", "Aldwin"), ("qui est le Vieux Sage", "Vieux"), ("Qui est gaston ?", None),
    ("parle-moi d'Entwood.", "Entwood"), ("Qui est l'Homme ?", "Homme"), ("bonjour", None)])
def test_lookup_entity(spark, text, entity):
    assert one(spark, C.lookup_entity, text) == entity


@pytest.mark.parametrize("fn, text, want", [
    (C.is_probe, "drop table users", True), (C.is_probe, "une phrase calme", False),
    (C.is_probe, "salut <@123>", True), (C.is_insult, "t'es nul", True),
    (C.is_insult, "ce robot est inutile", True), (C.is_insult, "annuler", False),
    (C.is_sincere_apology, "désolé pour hier", True), (C.is_sincere_apology, "désolé mdr", False),
    (C.is_identity_question, "mon rang ?", True), (C.is_identity_question, "voici mon rang", False),
    (C.is_anaphoric, "et elle, que fait-elle", True), (C.is_anaphoric, "ellen arrive", False),
    (C.is_continuation, "la suite !", True),
    (C.is_continuation, "raconte encore une histoire très longue", False),
    (C.is_self_report, "montre-moi mon dossier", True),
    (lambda c: C.is_member_question(c, F.lit("Ana")), "que sais-tu de ana ?", True),
    (lambda c: C.is_member_question(c, F.lit("Ana")), "que sais-tu de anatole ?", False),
    (lambda c: C.roles_question(c, F.lit("Ana")), "quels sont ses rôles ?", "last"),
    (lambda c: C.roles_question(c, F.lit("Ana")), "les rôles de ana", "member"),
    (lambda c: C.roles_question(c, F.lit(None).cast("string")), "les rôles", None),
    (C.story_lens, "l'éveil", "initiate"), (C.story_lens, "l'éveil de l'univers", None)])
def test_classifiers(spark, fn, text, want):
    assert one(spark, fn, text) == want


@pytest.mark.parametrize("markup, fields", [
    ("{{Infobox a\n| a = 1\n| b = 2\n| a = 3\n| c = 4\n}}", {"a": "3", "b": "2", "c": "4"}),
    ("{{Infobox a|x={{ref|n={{y}}}} text|y=[[page|shown]]|z=[[plain]]}}",
     {"x": "text", "y": "shown", "z": "plain"}),
    ("{{Infobox a\n| x = one\ntwo\n| y =\n}}", {"x": "one\ntwo"}),
    ("{{Infobox a| y = }} {{other|z=1}} {{Infobox b|x=''v''|w=a=b}}", {"x": "v", "w": "a=b"}),
    ("no box {{other|z=1}}", {}),
])
def test_infobox(spark, markup, fields):
    assert one(spark, M.infobox, markup) == fields


def test_insults_have_names_of_their_own(spark):
    for text, insult in [("sale ia", False), ("sale programme", False), ("mauvais programme", False),
                         ("sale bot", True), ("mauvais ia", True), ("programme inutile", True),
                         ("sale machine", True), ("pire robot", True)]:
        assert one(spark, C.is_insult, text) == insult, text
    assert one(spark, lambda c: C.is_insult(c, ("vasca",)), "sale vasca")


def test_templates_of_any_depth(spark):
    nested = "{{a|" * 12 + "core" + "}}" * 12
    assert one(spark, X.flatten_templates, f"x {nested} y {{{{open") == "x core y {{open"
    assert one(spark, X.template_depth, nested + "{{b}}") == 12


def test_rules_run_where_their_marks_stand(spark):
    """Looking for marks first changes nothing, whatever the text and the rules before."""
    rng = random.Random(3)
    bits = ["<", "</", ">", "/>", "<!--", "-->", "{|", "|}", "{{", "}}", "{{#if", "[[", "]]", "[",
            "]", "|", "#", "###", "==", "======", "'", "''", "'''''", "*", "**", ":", ";", "\n", "\n\n", "\t",
            " ", "a", "B2", "tD", "LI", "em", "I", "p", "SPAN", "u", "Ref", "br", "Source", "code",
            "mediaWiki", "http://x.y", "Quote", "spoiler", "In-Game description", "CANON", "theory",
            "{P3}", "{If ", "same", "ends", "ſ", "İ", "\r", "K"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 40))) for _ in range(3000)]
    # Whole templates and tags, cut at random places, so that rules match and make new text.
    whole = ["{{Quote|a|In-Game Description}}", "{{quote|b|c|d}}", "{{Spoiler|e}}", "{{ theory }}",
             "{{canon|f}}", "<TD x>", "<li>", "<em>", "</P>", "<span a>", "<ref/>", "<REF>g</Ref>",
             "[[h|i]]", "[[j#k]]", "[[MediaWiki:l]]", "[http://m n]", "=== o ===", "{Continues p}"]
    for _ in range(3000):
        parts = rng.choices(whole + bits, k=rng.randint(2, 12))
        texts.append("".join(x[rng.choice((0, 0, 1)):] + (x if rng.random() < 0.1 else "") for x in parts))
    df = spark.createDataFrame([(x,) for x in texts] + [(None,)], "t string").repartition(4)
    t = F.col("t")
    plain = {
        X.strip_blocks: (*X.BLOCK_RULES[::2], *X.BLOCK_RULES[1::2]),
        X.convert_tags: X.TAG_RULES, X.render_narrative: X.NARRATIVE_RULES,
        X.emphasis: X.EMPHASIS_RULES, X.normalise_links: X.LINK_RULES,
        X.reflow_headings: X.HEADING_RULES, X.indentation: X.INDENT_RULES,
        X.strip_instructions: X.INSTRUCTION_RULES,
        X.collapse_blank_lines: X.BLANK_RULES}
    known = {rule[0] for rules in plain.values() for rule in rules}
    assert set(X.MARKS) <= known and len(X.MARKS) > 30
    out = df.select("t", *(f(t).alias(f"a{i}") for i, f in enumerate(plain)), *(
        T.chain(t, rules).alias(f"b{i}") for i, rules in enumerate(plain.values()))).collect()
    for i, f in enumerate(plain):
        assert [r.t for r in out if r[f"a{i}"] != r[f"b{i}"]] == [], f.__name__
        assert sum(r[f"a{i}"] != r.t for r in out) > 50, f.__name__
