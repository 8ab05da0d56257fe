"""Retrieval, grounding and packing operators against brute force and hand-made cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import classify as C
from foliant.functions import embedding as EMB
from foliant.operators import directory as D
from foliant.operators import ground, retrieve as R
from foliant.operators import dialogue_chunks as DC
from foliant.operators import export, extract as E, graph as G, skew, sync


def cos(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))


@pytest.fixture(scope="module")
def space(spark):
    rng = random.Random(1)
    vecs = {i: [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(5)] for i in range(300)}
    vecs[7] = vecs[8] = vecs[9] = [1.0, 1.0, 0.0, 0.0, 1.0]
    rows = [(i, v) for i, v in vecs.items()] + [(900, None), (901, [0.0] * 5)]
    corpus = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(7)
    queries = {q: [rng.uniform(-1, 1) for _ in range(5)] for q in range(9)}
    qdf = spark.createDataFrame(list(queries.items()), "query_id long, embedding array<float>")
    return vecs, corpus, queries, qdf


def test_vector_topk_is_exact(space, monkeypatch):
    vecs, corpus, queries, qdf = space
    want = {}
    for q, v in queries.items():
        ranked = sorted((-round(cos(x, v), 5), i) for i, x in vecs.items() if any(x))
        want[q] = [round(-s, 4) for s, _ in ranked[:10]]
    for block, rows in ((2048, 100_000), (4, 100_000), (4, 50)):  # one block, then a grid
        monkeypatch.setattr(R, "QUERY_BLOCK", block)
        monkeypatch.setattr(R, "CORPUS_BLOCK", rows)
        got = {}
        for r in R.vector_topk(corpus, qdf, 10).orderBy("rank").collect():
            got.setdefault(r.query_id, []).append(round(r.score, 4))
        assert got.keys() == want.keys()
        for q in want:
            assert got[q] == pytest.approx(want[q], abs=2e-4)


def test_equal_vectors_rank_by_id(space, spark):
    _, corpus, _, _ = space
    q = spark.createDataFrame([(1, [1.0, 1.0, 0.0, 0.0, 1.0])], "query_id long, embedding array<float>")
    top = [r.chunk_id for r in R.vector_topk(corpus, q, 3).orderBy("rank").collect()]
    assert top[:3] == sorted(top[:3]) and set(top) >= {7, 8, 9}


def test_grid_of_nulls_and_of_nothing(space, spark, monkeypatch):
    _, corpus, _, qdf = space
    odd = qdf.union(spark.createDataFrame([(100, None), (101, [0.0] * 5)], qdf.schema))
    none = corpus.filter("false")
    for block in (2048, 2):
        monkeypatch.setattr(R, "QUERY_BLOCK", block)
        assert {r.query_id for r in R.vector_topk(corpus, odd, 2).collect()} == set(range(9))
        assert R.vector_topk(none, odd, 2).count() == 0
        assert R.vector_topk(corpus, odd.filter("false"), 2).count() == 0


def test_twenty_thousand_queries_are_one_plan(space, spark):
    vecs, corpus, _, _ = space
    rng = random.Random(6)
    many = {q: [float(rng.choice([-2, -1, 1, 3])) for _ in range(5)] for q in range(20_000)}
    got = {r.query_id: r.score for r in R.vector_topk(corpus, spark.createDataFrame(
        list(many.items()), "query_id long, embedding array<float>"), 1).collect()}
    assert len(got) == len(many)
    for q in range(0, 20_000, 997):
        assert got[q] == pytest.approx(max(cos(x, many[q]) for x in vecs.values() if any(x)))


@pytest.mark.parametrize("sizes", [(2048, 100_000), (2, 20)])
def test_cells_probe_all_is_exact(space, monkeypatch, sizes):
    _, corpus, _, qdf = space
    monkeypatch.setattr(R, "QUERY_BLOCK", sizes[0])
    monkeypatch.setattr(R, "CORPUS_BLOCK", sizes[1])
    real = corpus.filter("embedding IS NOT NULL")
    centres = R.train_cells(real, 6)
    filed = R.assign_cells(real, centres).withColumn("cell", F.get("cells", F.lit(0)))
    exact = R.vector_topk(corpus, qdf, 5)
    every = R.cell_topk(filed, qdf, centres, 5, 6)
    key = lambda df: {(r.query_id, r.chunk_id) for r in df.collect()}
    assert key(exact) == key(every)
    some = key(R.cell_topk(filed, qdf, centres, 5, 2))
    assert len(some & key(exact)) >= len(key(exact)) // 2


def test_probes_follow_the_recall_asked_for(spark):
    """Clustered vectors need few cells, vectors without clusters many; both reach the recall."""
    rng = random.Random(11)
    middles = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(16)]
    near = lambda m, far: [x + rng.gauss(0, far) for x in m]
    probed = []
    for far, base in ((0.1, middles), (1.0, [[0.0] * 12])):
        corpus = spark.createDataFrame(
            [(i, near(rng.choice(base), far)) for i in range(800)], "chunk_id long, embedding array<float>")
        asked = spark.createDataFrame(
            [(q, near(rng.choice(base), far)) for q in range(60)], "query_id long, embedding array<float>")
        centres = R.train_cells(corpus, 16)
        filed = R.assign_cells(corpus, centres).withColumn("cell", F.get("cells", F.lit(0)))
        probes = R.probes_for(filed, asked, centres, 10, sample=30)
        probed.append(probes)
        exact = R.vector_topk(corpus, asked, 10).select("query_id", "chunk_id")
        hits = R.cell_topk(filed, asked, centres, 10, probes).join(exact, ["query_id", "chunk_id"])
        assert hits.count() >= 0.9 * exact.count()
    assert probed[0] < probed[1] <= 16


def test_registered_recall(spark):
    from foliant.plans import QUERIES
    got = [r.recall for r in QUERIES["ann_recall"](spark, "/root/testdata/sf0.1").collect()]
    assert sum(got) / len(got) >= 0.9


DOCS = [(1, "Les gardiens du temple parlent doucement"), (2, "Le gardien parle"),
        (3, "temple vide et silencieux"), (4, "gardien gardiens temple temple temple")]


def test_lexical_channel(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "chunk_id long, content string")

    def hits(question):
        q = spark.createDataFrame([(1, question)], "query_id long, question string")
        return {r.chunk_id: round(r.score, 4) for r in R.lexical_topk(docs, q, C.STOPWORDS).collect()}

    assert hits("gardien temple").keys() == {1, 4}
    assert hits("gardien temple")[4] == 1.0
    assert hits("gardien -temple").keys() == {2}
    assert hits("silencieux or parle").keys() == {2, 3}
    assert hits("absent gardien") == {}
    assert hits("dans avec pour") == {}
    assert hits("gardien or -temple gardien or gardien -vide") == hits("gardien")
    many = spark.createDataFrame([(i, w) for i, w in enumerate(["gardien", "temple", "vide"])],
                                 "query_id long, question string")
    got = {(r.query_id, r.chunk_id) for r in R.lexical_topk(docs, many, C.STOPWORDS).collect()}
    assert got == {(0, 1), (0, 2), (0, 4), (1, 1), (1, 3), (1, 4), (2, 3)}
    # The same from an index written before, and with salted lookups.
    index = R.postings(docs, C.STOPWORDS)
    assert {(r.term, r.chunk_id, r.tf, r.size) for r in index.filter("chunk_id = 4").collect()} == {
        ("gardien", 4, 2, 5), ("templ", 4, 3, 5)}  # stems
    monkeypatch.setattr(skew.lookup_join, "__defaults__", ("inner", 0))
    assert got == {(r.query_id, r.chunk_id) for r in R.lexical_topk(
        docs.filter("false"), many, C.STOPWORDS, index=index).collect()}


def test_lexical_hits_against_brute_force(spark):
    rng = random.Random(13)
    words = ["gardien", "temple", "vide", "ombre", "lune", "pont", "tour", "bois"]
    docs = [(i, " ".join(rng.choices(words, weights=[9, 5, 3, 2, 1, 1, 1, 1], k=rng.randint(0, 12))))
            for i in range(120)]
    asked, want = [], {}
    for q in range(60):
        alts = [([*rng.sample(words, rng.randint(1, 3))], rng.sample(words, rng.choice([0, 0, 1])))
                for _ in range(rng.randint(1, 2))]
        asked.append((q, " or ".join(" ".join([*yes, *("-" + w for w in no)]) for yes, no in alts)))
        for i, text in docs:
            held = text.split()
            scores = [sum(w in yes for w in held) / len(held) for yes, no in alts
                      if set(yes) <= set(held) and not set(no) & set(held)]
            if scores:
                want[q, i] = max(scores)
    hits = R.lexical_topk(spark.createDataFrame(docs, "chunk_id long, content string"),
                          spark.createDataFrame(asked, "query_id long, question string"),
                          C.STOPWORDS, k=1000)
    got = {(r.query_id, r.chunk_id): r.score for r in hits.collect()}
    assert got == pytest.approx(want) and want


def test_lexical_tasks_stay_small(spark, monkeypatch):
    """More passages make more tasks, not larger ones; rows that share an id stay apart or merge."""
    docs = [(i, "gardien temple " + "ombre " * (i % 7)) for i in range(400)]
    docs += [(400, "gardien"), (400, "gardien lune"), (401, "gardien pont"), (401, "gardien tour"),
             (None, "gardien")]
    df = spark.createDataFrame(docs, "chunk_id long, content string")
    asked = spark.createDataFrame([(1, "gardien -ombre or temple"), (2, "gardien pont")],
                                  "query_id long, question string")
    dealt = []
    repartition = type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, n, *c: dealt.append(n) or repartition(
        self, n, *c))

    def hits():
        return {(r.query_id, r.chunk_id): r.score for r in R.lexical_topk(
            df, asked, C.STOPWORDS, 500).collect()}

    want = hits()
    monkeypatch.setattr(R, "PAIRS", 50)
    assert hits() == want and dealt[0] <= 8 and dealt[1] >= 16
    assert want == {(1, i): 1 / (2 + i % 7) if i % 7 else 0.5 for i in range(400)} | {
        (1, 400): 1.0, (1, 401): 1.0, (2, 401): 1.5}
    best = {(r.query_id, r.chunk_id) for r in R.lexical_topk(df, asked, C.STOPWORDS, 3).collect()}
    assert best == {(1, 400), (1, 401), (1, 0), (2, 401)}


def test_fusion(spark):
    schema = "query_id long, chunk_id long, score double, rank int"
    v = spark.createDataFrame([(1, 10, 0.5, 1), (1, 11, -0.2, 2), (1, 12, 1.5, 3)], schema)
    x = spark.createDataFrame([(1, 10, 1.0, 1), (1, 13, 3.0, 2)], schema)
    got = {r.chunk_id: (r.cosine_score, r.ts_score, round(r.score, 6)) for r in R.fuse_channels(v, x).collect()}
    assert got == {10: (0.5, 0.5, 0.5), 11: (0.0, None, 0.0), 12: (1.0, None, 0.6), 13: (None, 0.75, 0.3)}


def test_merge_and_ordered_dedup(spark):
    schema = "query_id long, chunk_id long, score double, channel string, page_title string, content string"
    a = spark.createDataFrame([(1, 1, 0.9, "lore", "P", "x"), (1, 2, 0.2, "lore", "P", "y")], schema)
    b = spark.createDataFrame([(1, 1, 0.95, "rows", "P", "x"), (1, 9, 0.5, "rows", "Q", "z")], schema)
    got = [(r.channel, r.chunk_id, r.score) for r in R.merge_channels([a, b], 2).orderBy("rank").collect()]
    assert got == [("rows", 1, 0.95), ("rows", 9, 0.5)]
    first = R.dedup_in_order(a.unionByName(b), [F.col("channel").asc()])
    assert {(r.channel, r.content) for r in first.collect()} == {("lore", "x"), ("lore", "y"), ("rows", "z")}


def test_dossier_pages_and_ban_list(spark):
    rows = [(i, 1, "Brann/Quotes", i, "a") for i in range(2)] + [
        (10, 2, "brann", 0, "b"), (11, 3, "About Brann", 0, "c"), (12, 4, "Other", 0, "says brann here"),
        (13, 5, "Other", 0, "nothing"), (14, 6, "Brann (fr)", 0, "d")]
    df = spark.createDataFrame(rows, "chunk_id long, page_id long, page_title string, chunk_index int, content string")
    first = R.dossier(df, ["brann"], 3)
    page = first.orderBy("rn").collect()
    assert [r.chunk_id for r in page] == [10, 14, 0] and all(r.more for r in page)
    second = R.dossier(df, ["brann"], 3, consumed=first).orderBy("rn").collect()
    assert [r.chunk_id for r in second] == [1, 11, 12] and not any(r.more for r in second)


def test_context_budget_keeps_the_first(spark):
    hits = spark.createDataFrame([(1, i, i, "T", "x" * n) for i, n in enumerate((50, 10, 10), 1)],
                                 "query_id long, chunk_id long, rank int, page_title string, content string")
    row = R.assemble_context(hits, 20).collect()[0]
    assert row.used_ids == [1] and row.context.startswith("[T] xxx")
    assert R.assemble_context(hits, 80).collect()[0].used_ids == [1, 2]


def test_patterns_and_suggestions(spark, monkeypatch):
    titles = spark.createDataFrame([("Pattie",), ("Patters",), ("Aldwin Entwood",), ("The Fox",)], "page_title string")
    pats = spark.createDataFrame([("pat",), ("fox",), ("zz",)], "pattern string")
    for limit in (1_000_000, 0):  # lookups broadcast, then salted
        monkeypatch.setattr(skew.lookup_join, "__defaults__", ("inner", limit))
        got = {(r.page_title, r.pattern) for r in R.contained_patterns(titles, "page_title", pats, ["page_title"]).collect()}
        assert got == {("Pattie", "pat"), ("Patters", "pat"), ("The Fox", "fox")}
    q = spark.createDataFrame([(1, "qui est pattie ?"), (2, "parle de patt"), (3, "aldwin et fox")],
                              "query_id long, question string")
    assert {r.query_id: r.suggestion for r in R.suggest_titles(q, titles).collect()} == {
        1: "Pattie", 3: "Aldwin Entwood"}


def test_many_patterns_against_brute_force(spark):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcé 😀_%") for _ in range(n))
    texts = [word(rng.randint(0, 60)) for _ in range(150)] + ["abc" * 40, "", "a", None, "ABC\nabc"]
    texts += texts[:5]
    pats = {word(rng.randint(1, 6)) for _ in range(4000)} | {"", "abcabc", "c\na"}
    got = sorted((r.i, r.pattern) for r in R.contained_patterns(
        spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t",
        spark.createDataFrame([(p,) for p in pats] + [(None,), ("abcabc",)], "pattern string"),
        ["i"]).collect())
    assert got == sorted((i, p) for i, t in enumerate(texts) for p in pats if t and p and p in t.lower())
    none = spark.createDataFrame([], "pattern string")
    assert R.contained_patterns(spark.createDataFrame([(1, "abc")], "i int, t string"), "t", none,
                                ["i"]).count() == 0


def test_a_hundred_thousand_patterns(spark):
    titles = spark.range(500).selectExpr("concat('title number ', id, ' of all') AS t")
    pats = spark.range(100_000).selectExpr("concat('number ', id, ' of') AS pattern")
    got = R.contained_patterns(titles, "t", pats, ["t"])
    assert got.count() == 500


def test_headline(spark):
    text = " ".join(["a"] * 60 + ["gold", "b", "gold"] + ["c"] * 60)
    df = spark.createDataFrame([(text,)], "t string")
    got = R.best_fragment(df, F.split("t", " "), F.array(F.lit("gold")), "h").collect()[0].h
    assert got.count("gold") == 2 and len(got.split()) == 40


@pytest.mark.parametrize("answer, context, want", [
    ("Le sage Aldwin parle.", "aldwin entwood", set()),
    ("Le sage Zorvax parle.", "rien", {"zorvax"}),
    ("Le Codex dit vrai.", "", set()),
    ("L'homme d'Orvane et orvane.", "", set()),
    ("Les Gardiennes arrivent. Voici Gardiennes.", "un gardienn", set()),
    ("Zorvax seul ouvre la phrase.", "", set()),
    ("Un Énergétique Tissage.", "", set())])
def test_grounding(spark, answer, context, want):
    df = spark.createDataFrame([(1, answer, context)], "query_id long, answer string, context string")
    assert {r.entity for r in ground.unsupported(df).collect()} == want


def test_archive_excuse(spark):
    words = spark.createDataFrame([(1, "gardiens"), (1, "zorvax"), (2, "hérétique")], "query_id long, w string")
    vocab = spark.createDataFrame([("gardien",), ("heretic",)], "word string")
    assert {r.w for r in ground.absent_from_archive(words, vocab, "w").collect()} == {"zorvax"}


def test_missing_entity(spark):
    rows = spark.createDataFrame([(1, "Ana", "he met ANA"), (1, "Ana", "x"), (2, "Bob", "nobody")],
                                 "query_id long, entity string, content string")
    assert {r.query_id: r.missing for r in ground.missing_entity(rows, "entity").collect()} == {1: False, 2: True}


def test_backfill_keeps_vectors_and_checks_size(spark):
    rows = spark.createDataFrame([(1, "a b", None), (2, "c", [1.0] * 64)], "chunk_id long, content string, embedding array<float>")
    got = {r.chunk_id: r.embedding for r in EMB.backfill(rows, EMB.hashed_terms()).collect()}
    assert got[2] == [1.0] * 64 and list(got[1]) == list(EMB.hashed_counts("a b"))
    with pytest.raises(Exception, match="dimension"):
        EMB.backfill(rows, EMB.hashed_terms(8)).collect()


def test_lookup_join_salted_equals_broadcast(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)], "id long, k string")
    table = spark.createDataFrame([("hot", 1), ("k3", 2), ("k9", 3)], "k string, v int")
    for how in ("inner", "left"):
        a = skew.lookup_join(left, table, ["k"], F.col("id"), how)
        b = skew.lookup_join(left, table, ["k"], F.col("id"), how, max_rows=1)
        assert sorted(map(str, a.select("id", "k", "v").collect())) == sorted(map(str, b.select("id", "k", "v").collect()))


def test_members_and_roles(spark):
    msgs = spark.createDataFrame([(1, "bonjour pa77ie"), (2, "salut marl"), (3, "avec qui"), (4, "rien ici")], "id long, text string")
    names = spark.createDataFrame([("Pattie",), ("MarloDels",), ("avecina",)], "name string")
    got = {r.id: (r.token, r.exact) for r in D.resolve_members(msgs, names, C.STOPWORDS, "id").collect()}
    assert got == {1: ("pa77ie", True), 2: ("marl", False)}


@pytest.mark.parametrize("value, want", [
    ('"  a "', "a"), ('["a", null, " ", "b"]', "a b"), ('{"name": "n", "value": "v"}', "n"),
    ('{"0": "z"}', "z"), ('{"x": 1}', None), ("null", None), ("12", "12"), ('""', None)])
def test_poly_text(spark, value, want):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(D.poly_text(F.col("v")).alias("t")).collect()[0].t == want


def test_sync_guards(spark):
    stored = spark.createDataFrame([("b", 1, "x"), ("b", 2, "y")], "bucket string, id int, touched string")
    empty = stored.filter("false")
    assert sync.vanished(stored, empty, ["bucket", "id"]).count() == 2
    assert sync.vanished(stored, empty, ["bucket", "id"], allow_empty=False).count() == 0
    live = spark.createDataFrame([("b", 1, "x", False), ("b", 2, "z", False), ("b", 3, None, False), ("b", 4, "q", True)],
                                 "bucket string, id int, touched string, missing boolean")
    got = {r.id: r.reason for r in sync.delta_plan(live, stored, ["bucket", "id"]).collect()}
    assert got == {2: "changed", 3: "no_signal"}
    assert sync.delta_plan(live, stored, ["bucket", "id"], force=True).count() == 3


def test_dialogue_chunks(spark):
    lines = [(1, i, s, t) for i, (s, t) in enumerate([
        ("Ana", "a" * 30), ("Bob", "b" * 30), ("Ana", "c" * 30), ("Cy", "d" * 150), ("bad.", "e" * 20), ("Bob", "f")])]
    df = spark.createDataFrame(lines, "page_id long, message_order long, speaker string, message_text string")
    got = DC.dialogue_chunks(DC.render_lines(df), 90, 10).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in got] == list(range(len(got)))
    assert [r.speakers for r in got] == [["Ana", "Bob"], ["Ana", "Bob"], ["Cy"], ["Cy"], ["Cy"], ["Bob"]] or \
        [r.speakers for r in got] == [["Ana", "Bob"], ["Ana", "Bob"], ["Cy"], ["Cy"], ["Bob"]]
    bodies = [r.content_markdown.split("\n", 1)[1] for r in got]
    assert max(map(len, bodies)) <= 90
    long_line = "> **Cy:** " + "d" * 150
    pieces = [b for r, b in zip(got, bodies) if r.speakers == ["Cy"]]
    assert pieces[0] + "".join(p[10:] for p in pieces[1:]) == long_line


def test_export_manifest(spark):
    pages = spark.createDataFrame([("b", f"t{i}", i, "canon", "w " * 10) for i in range(5)],
                                  "bucket_id string, page_title string, page_id long, canon_status string, content_markdown string")
    m = export.part_manifest(export.export_parts(pages, 35), 35, 100).orderBy("group_no").collect()
    assert [r.pages for r in m] == [2, 2, 1] and m[0].file_name == "b_part1.md" and m[2].label == "b (part 3/3)"


def test_chaptered_dialogue(spark):
    md = "\n".join(["> **Ivor:** before", "## One", "> **Ivor:** hi {Convo. ends.}", "> > go on", "[Convo ends]",
                    "> Update: 3 items", "> **Ivor:** 40%", "## Two", "> Gaston : bye", "(convo. ends)"])
    df = spark.createDataFrame([(1, md)], "page_id long, content_markdown string")
    got = [(r.message_order, r.speaker, r.message_text, r.player_choice, r.chemistry_gain, r.chapter)
           for r in E.chaptered_rows(df, skip_intro=True).orderBy("message_order").collect()]
    assert got == [(0, "Ivor", "hi", False, True, "One"), (1, "", "go on", True, True, "One"),
                   (2, "Gaston", "bye", False, True, "Two")]
    assert E.chaptered_rows(df, skip_intro=False).count() == 4


def test_conversations_and_versions(spark):
    md = "\n".join(["## Rank 1 - Neutral", "### Conversation 2", "> a", "### Conversation 2", "> b",
                    "## Rank 2: Liked", "### Free talk", "> c"])
    df = spark.createDataFrame([(1, "Chat/Ivor B", md)], "page_id long, page_title string, content_markdown string")
    got = [(r.conversation_id, r.title, r.rank, r.body.split("\n")[-1]) for r in E.split_conversations(df).collect()]
    assert sorted(got) == [("IvorBRank1Convo2", "Conversation 2", "Rank 1 - Neutral", "> a"),
                           ("IvorBRank1Convo2-2", "Conversation 2", "Rank 1 - Neutral", "> b"),
                           ("IvorBRank2Freetalk", "Free talk", "Rank 2 - Liked", "> c")]
    md = "text\n## Patch History\nnoise\n**Update 27.2**\n* Fixed {x} it\n- more\n[ref]\nHotfix 1.0\n# Next\nz"
    df = spark.createDataFrame([(1, md)], "page_id long, content_markdown string")
    notes = [(r.version, r.notes) for r in E.version_notes(df).collect()]
    assert notes == [("Update 27.2", ["Fixed  it", "more"])]
    body = df.select(E.without_version_notes(F.col("content_markdown")).alias("b")).collect()[0].b
    assert body == "text\n"


def test_native_graph(spark):
    n = lambda i, t, **k: {"Id": i, "type": G.ENGINE + t, **k}
    nodes = [n(5, "StartDialogueNode", Content="GastonRank1", Outgoing=[1, 2]),
             n(1, "DialogueNode", Content="hello", Outgoing=[3, 99]), n(2, "PlayerChoiceDialogueNode", Content="me", Outgoing=[1]),
             n(3, "EndDialogueNode", Outgoing=[4]), n(4, "DialogueNode", Content="after end", Outgoing=[1, 1]),
             n(None, "DialogueNode", Content="no id"), n(8, "DialogueNode", Content="lost"),
             n(9, "IncCounterDialogueNode", Content="trust 2"),
             n(10, "CheckCounterDialogueNode", CounterName="trust", Outputs=[{"Expression": "> 1"}]),
             n(11, "ScriptDialogueNode", Script={"Script": "s", "Function": "f"}),
             n(12, "SpecialCompletionDialogueNode", CompletionType="3",
               OtherDialogueInfos=[{"Tag": "t", "Dialogue": "d"}, {"Dialogue": "e"}]),
             {"Id": 13, "type": "/Other/DialogueNode", "Content": "alike"}]
    df = spark.createDataFrame([("f", nodes)], f"file string, nodes array<{G.NODE}>")
    w = G.conversation_walks(df).collect()[0]
    assert w.reached == [5, 1, 3, 4, 2] and w.listed == [1, 2]
    edges = [(r.source, r.target, r.slot) for r in G.file_edges(df).collect()]
    assert sorted(edges) == [(1, 3, 0), (2, 1, 0), (3, 4, 0), (4, 1, 0), (4, 1, 1), (5, 1, 0), (5, 2, 1)]
    texts = {r.node: r.text for r in G.file_nodes(df).collect()}
    assert texts[3] == "Chat finished" and texts[1] == "hello" and 8 in texts
    assert texts[9] == "Increment counter: trust +2"
    assert texts[10] == "Check counter: trust\n> 1" and texts[11] == "Run script: s :: f"
    assert texts[12] == "Special completion (type 3)\nt (d)\ne"
    assert texts[13] == "System action: DialogueNode\nalike"


def test_reachable_cap_and_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("x", "y")], "source string, target string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.depth) for r in G.reachable(edges, seeds).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert {r.node for r in G.reachable(edges, seeds, max_nodes=2).collect()} == {"a", "b"}


def test_terms_of_many_texts_are_counted_at_once(monkeypatch):
    """As word by word; words beyond those remembered are made again."""
    texts = ["b a b", None, "", "Été a'b-c ß", "a " * 50, "x y z w v"] * 100
    want = []
    for text in texts:
        row = np.zeros(16)
        for word in EMB._WORD.findall((text or "").lower()):
            at, sign = EMB._slot(word, 16)
            row[at] += sign
        want.append(row)
    monkeypatch.setattr(EMB, "WORDS", 3)
    assert (EMB._counts(texts, EMB._Cells(16)) == np.array(want)).all()
    assert (EMB.hashed_counts("b a b", 16) == want[0]).all() and len(EMB.hashed_counts("")) == 64
