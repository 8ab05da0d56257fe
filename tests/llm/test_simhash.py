"""SimHash near-duplicates against a brute-force version."""

import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from foliant.llm import hamming, simhash_dedup
from foliant.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_fingerprint(text, n=4):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, distance=4):
    """rows: (doc_id, text)"""
    fps = [slow_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)].append(doc)
    return sorted(((d, f"{fps[i]:016x}", min(least[find(i)], default=None))
                   for i, (d, _) in enumerate(rows)), key=repr)


def test_small_table_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"Wörd{i}" for i in range(300)]
    base = [" ".join(rng.choice(vocabulary, 150)) for _ in range(6)]
    rows = [(None, base[0]), (900, None), (901, ""), (902, " \t\n"), (903, "a b"), (904, "A  b"),
            (905, "x" * 50_000), (906, "y z " * 30_000), (906, "y z " * 30_000)]
    for k, text in enumerate(base):
        for c in range(12):
            words = text.split()
            for _ in range(c % 3):
                words[rng.integers(len(words))] = "changed"
            rows.append((100 * k + c, " ".join(words)))
    df = spark.createDataFrame(
        [(d, t, "x", 1) for d, t in rows],
        "doc_id long, text string, component_id string, fp int").repartition(5)
    out = simhash_dedup.near_duplicates(df)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    expected = slow_components(rows)
    assert len({r[2] for r in expected}) < len(expected) - 20
    assert sorted((tuple(r) for r in out.collect()), key=repr) == expected
    kept = simhash_dedup.keep_one_of_each(df)
    assert kept.columns == df.columns
    want = sorted({r[0] for r in expected if r[0] == r[2] and r[0] is not None}) + [None]
    got = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x))
    assert got == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_dedup.near_duplicates(df).count() == 0
    assert simhash_dedup.keep_one_of_each(df).count() == 0


def test_text_longer_than_a_piece(monkeypatch):
    text = " ".join(f"W{i}" for i in range(5000))
    whole = simhash_dedup.fingerprint(text)
    monkeypatch.setattr(simhash_dedup, "PIECE", 7)
    assert simhash_dedup.fingerprint(text) == whole == slow_fingerprint(text)


@pytest.mark.parametrize("limits", [(512, 2048, 1024), (2, 3, 4)])
def test_links_connect_as_all_pairs_do(spark, monkeypatch, limits):
    """Also with limits so small that every large bucket is dealt over chunks."""
    for name, value in zip(("BUCKET", "CHUNK", "SQUARE"), limits):
        monkeypatch.setattr(hamming, name, value)
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = set(map(int, rng.integers(0, 2**63, 300, dtype=np.uint64)))
    for c in centres:
        for _ in range(20):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(3)
    labels = {r.node: r.label for r in components(
        hamming.hamming_links(df, 4, len(fps))).collect()}
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    label = np.arange(len(fps))
    signed = fps.view(np.int64)
    while True:
        new = np.array([signed[label[close[i]]].argmin() for i in range(len(fps))])
        new = np.array([label[close[i]][new[i]] for i in range(len(fps))])
        if (new == label).all():
            break
        label = new
    for i in range(len(fps)):
        assert labels.get(int(signed[i]), int(signed[i])) == int(signed[label[i]])


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)]
    loops = [(7, 7), (2000, 2000), (None, 5), (61, 3)]
    df = spark.createDataFrame(chain + loops, "a long, b long")
    got = {r.node: r.label for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(62)}, **{1000 + i: 1000 for i in range(50)}}
    assert components(df.limit(0)).count() == 0
