"""Fill-in-the-middle against a plain version, round trips and odd rows."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import fill_middle as m

SF = "/root/testdata/sf0.01"


def slow(doc_id, text):
    """The rule, word for word, without pieces."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    hexes = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexes[i:i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


ROWS = [(1, None), (2, ""), (3, "a"), (4, "a<P>b"), (5, "<<<S>"), (6, "x <"), (7, "P>S>M>" * 9),
        (8, "ä\nö  1 2 3 naïve é\U0001f600!"), (None, "no id at all"), (None, "no id at all"),
        (9, "same row twice"), (9, "same row twice"), (9, "same id, other text"),
        (10, "a" * 100_000), (11, "a b" * 30_000), (12, "<" * 70), (13, "\x00\t\r"),
        *((i, f"document {i}: " + "one, two; " * (i % 7)) for i in range(100, 300))]


@pytest.mark.parametrize("parts", [1, 5])
def test_against_plain_version(spark, parts):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr(
        "*", "'x' AS row", "'y' AS form", "1 AS pos").repartition(parts)
    want = []
    for doc_id, text in ROWS:
        n, form, p, q, out = slow(doc_id, text)
        want.append((doc_id, n, form, p, q, out, text or ""))
    got = m.digests(df)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256",
                           "restored_sha256"]
    key = repr
    assert sorted(map(tuple, got.collect()), key=key) == sorted(
        ((*w[:5], sha(w[5]), sha(w[6])) for w in want), key=key)
    texts = m.fill_in_middle(df).collect()
    assert sorted(map(tuple, texts), key=key) == sorted((w[:6] for w in want), key=key)
    assert sorted(m.restore(r.text, r.form) for r in texts) == sorted(w[6] for w in want)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert m.digests(df).collect() == [] and m.fill_in_middle(df).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 500), st.text(alphabet="ab<PSM> \né"))
def test_pieces_make_the_output(doc_id, text):
    rows = list(m.pieces_of(doc_id, text))
    assert [r[0] for r in rows] == list(range(len(rows)))
    n, form, p, q, out = slow(doc_id, text)
    assert rows[0][1:6] == (doc_id, n, form, p, q) and "".join(r[-1] for r in rows) == out
    assert m.restore(out, form) == text


def test_pieces_are_bounded_and_cut_between_units():
    text = "word, " * 50_000 + "z" * 60_000
    rows = list(m.pieces_of(3, text))
    assert len(rows) > 50 and max(len(r[-1]) for r in rows) <= m.CHARS + 3
    starts = set(m.unit_starts(text).tolist())
    assert len(starts) == 50_000 * 3 + 1


def test_one_exchange(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    plan = m.digests(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 2


def test_whole_query(spark):
    from foliant.llm.queries import op11_fill_middle
    got = {r.doc_id: tuple(r)[1:] for r in op11_fill_middle(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        n, form, p, q, out = slow(r.doc_id, r.text)
        assert got[r.doc_id] == (n, form, p, q, sha(out), sha(r.text or ""))
