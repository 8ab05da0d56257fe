"""The string kernel, its Nystroem regression and held-out accuracy."""

import zlib

import numpy as np
import pytest

from foliant.llm import language_kernel as k

SF = "/root/testdata/sf0.1"


def slow_grams(text):
    folded = "".join(c if c.isalpha() else " " for c in text.lower())
    folded = " " + " ".join(folded.split()) + " " if folded.strip() else " "
    return {folded[i:i + n] for n in k.ORDERS for i in range(len(folded) - n + 1)}


@pytest.mark.parametrize("text", [
    "", "a", "The cat, the HAT", "x1y2 é - é\n\nword", "日本語 text 😀", "ab" * 5000, "..!!", "𐐀𐐁 𐌰\ud800x"])
def test_grams_count_as_the_plain_ones(text):
    assert len(k.grams(text)) == len(slow_grams(text))


def test_kernel_value():
    texts = ["the cat sat", "the hat", "some other words"]
    sets = [k.grams(t) for t in texts]
    plain = [slow_grams(t) for t in texts]
    got = k._kernel(sets, sets)
    for i in range(3):
        for j in range(3):
            want = len(plain[i] & plain[j]) / np.sqrt(len(plain[i]) * len(plain[j]))
            assert got[i, j] == pytest.approx(want, rel=1e-5)


def test_with_every_text_a_landmark_it_is_kernel_ridge_regression():
    """The Nystroem map is then exact: the scores solve the regression in the kernel itself."""
    rng = np.random.default_rng(0)
    sounds = {"x": ["ta", "ko", "ri"], "y": ["sch", "ein", "und"], "z": ["éa", "lou", "ch"]}
    texts, names = [], []
    for name, parts in sounds.items():
        for _ in range(12):
            texts.append(" ".join("".join(rng.choice(parts, 3)) for _ in range(12)))
            names.append(name)
    sets = [k.grams(t) for t in texts]
    model = k.fit_sets(sets, names, landmarks=100, ridge=0.05)
    kernel = k._kernel(sets, sets).astype(float)
    wanted = (np.array(names)[:, None] == np.array(["x", "y", "z"])).astype(float)
    # min |K a - Y|^2 / 12 + 0.05 a'Ka
    solution = np.linalg.solve(kernel / 12 + 0.05 * np.eye(36), wanted / 12)
    new = [k.grams("".join(rng.choice(sounds[n], 9))) for n in "xyzzy"]
    assert model.scores(new) == pytest.approx(k._kernel(new, sets) @ solution, abs=1e-3)
    assert [model.languages[i] for i in model.scores(new).argmax(1)] == list("xyzzy")


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = k.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter(
        "held_out").collect()
    assert len(rows) > 2000
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_edge_rows(spark):
    rows = [(i, "the cat and the dog ran over there", "en") for i in range(30)]
    rows += [(100 + i, "die katze und der hund laufen über", "de") for i in range(30)]
    rows += [(200, None, "en"), (201, "", "de"), (202, "12 !?", None), (None, "the dog", "en"),
             (203, "und der hund " * 20_000, None), (0, rows[0][1], "en"), (204, "é", None)]
    df = spark.createDataFrame([(*r, "p", 2.0) for r in rows],
                               "doc_id long, text string, lang string, lang_pred string, "
                               "score double")
    out = k.identify(df)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = out.collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert {by[i].lang_pred for i in (200, 201, 202)} == {"und"}
    assert by[203].lang_pred == "de" and by[None].lang_pred == "en" and by[5].lang_pred == "en"
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert k.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in k.identify(df.withColumn("lang", df.lang.substr(0, 0)).filter(
        "false").union(df.selectExpr("doc_id", "text", "null", "lang_pred", "score"))).collect()
    } == {"und"}


def test_slices_of_a_long_text(monkeypatch):
    rng = np.random.default_rng(2)
    text = "".join(rng.choice(list("abcdé жд日 "), 500))
    whole = k.grams(text)
    for size in (1, 2, 7, 100):
        monkeypatch.setattr(k, "SLICE", size)
        assert np.array_equal(k.grams(text), whole)


def test_many_scripts_are_told_apart(spark):
    """Languages of seven scripts, over 300 letters in all, half of them in rare rows."""
    rng = np.random.default_rng(3)
    first = {"la": 0x61, "el": 0x3B1, "ru": 0x430, "he": 0x5D0, "hi": 0x915, "th": 0xE01,
             "ko": 0xAC00, "zh": 0x4E00, "ja": 0x3041, "zz": 0x20000}
    rows = []
    for name, start in first.items():
        letters = [chr(start + i) for i in range(20 if name != "zh" else 200)]
        for _ in range(200 if name == "la" else 25):
            words = ["".join(rng.choice(letters, 4)) for _ in range(12)]
            rows.append((len(rows), " ".join(words), name))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in k.identify(df).collect()}
    wrong = [n for i, _, n in rows if got[i].held_out and got[i].lang_pred != n]
    assert wrong == [] and sum(r.held_out for r in got.values()) > 60
