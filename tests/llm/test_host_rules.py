"""Host rules against plain counting."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import host_rules as h

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_measure(text):
    text = text or ""
    words = WORD.findall(text)
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeats += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats,
            len(covered))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab #|\n\t\x0b\x1cé "), max_size=120))
def test_measures(text):
    assert h.measure(text) == slow_measure(text)


@pytest.mark.parametrize("text", [
    None, "", " \n", "a " * 9, "a " * 8, "x y z " * 40, "\n".join(["l one", "l one", " l one"])])
def test_measures_of_odd_texts(text):
    assert h.measure(text) == slow_measure(text)


def test_repeats_in_a_long_text():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in rng.integers(0, 5000, 3000)]
    text = " ".join(words + words[100:140] + ["end"] + words[120:127])
    assert h.measure(text) == slow_measure(text)
    assert h.measure("word " * 200_000)[4] == 200_000


def slow_rates(counts):
    """counts: {host: (docs, failures)} -> shrunk rates"""
    rates = [f / n for n, f in counts.values()]
    size = len(counts) / sum(1 / n for n, _ in counts.values())
    mean, var = np.mean(rates), np.var(rates)
    beyond = var - mean * (1 - mean) / size
    strength = 1e6 if beyond <= 0 else max(1.0, min(1e6, mean * (1 - mean) / beyond - 1))
    return {k: (f + mean * strength) / (n + strength) for k, (n, f) in counts.items()}


def test_hosts(spark):
    good = " ".join(f"word{i}" for i in range(30))
    rows, doc = [], 0
    for host, docs, bad in [("a", 40, 2), ("b", 200, 20), ("junk", 50, 45), ("one", 1, 1),
                            (None, 10, 0), ("é", 3, 1)]:
        for i in range(docs):
            rows.append((doc, "too short" if i < bad else good, host))
            doc += 1
    rows += [(None, good, "a"), (7000, None, "b"), (7001, "", "b"), (7002, good, "b"),
             (7002, good, "b"), (7003, "same again now " * 50_000, "b")]
    df = spark.createDataFrame([(*r, True, 9) for r in rows],
                               "doc_id long, text string, source string, kept boolean, host int")
    counts = {}
    for _, t, s in rows:
        n, f = counts.get(s, (0, 0))
        m = h.measure(t)
        counts[s] = (n + 1, f + (m[0] < 20 or 100 * m[4] > 30 * m[0]))
    want = slow_rates(counts)
    got = {r.host: r for r in h.host_rates(h.with_measures(df)).collect()}
    for s, rate in want.items():
        r = got["n" if s is None else "s" + s]
        assert (r.docs, r.failed_base) == counts[s] and r.rate_base == pytest.approx(rate)
    assert want["junk"] > 0.5 > want["b"]
    assert want["one"] < 1
    out = h.judge(df)
    assert out.columns == ["doc_id", *h.COUNTS, "base_failed", "kept"]
    judged = out.collect()
    assert len(judged) == len(rows)
    expected = sorted(((d, *h.measure(t), bool(h.measure(t)[0] < 20 or (
        100 * h.measure(t)[4] > 30 * h.measure(t)[0]))) for d, t, _ in rows), key=repr)
    assert sorted((tuple(r)[:7] for r in judged), key=repr) == expected
    by = {r.doc_id: r for r in judged}
    for d, t, s in rows:
        if d is not None:
            r = by[d]
            assert r.kept == (not r.base_failed and max(
                v for k, v in got["n" if s is None else "s" + s].asDict().items()
                if k.startswith("rate_")) <= 0.5)
    assert h.judge(df.limit(0)).count() == 0
