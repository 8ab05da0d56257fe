"""The line classifier: exact marginals, held-out accuracy, edge cases."""

import itertools
import math
import zlib

import numpy as np
import pytest

from foliant.llm import quality_crf as q

SF = "/root/testdata/sf0.1"


def test_marginals_equal_all_paths():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        moves = tuple(map(tuple, rng.normal(size=(2, 2)).tolist()))
        odds = rng.normal(0, 3, n).tolist()
        weight = {}
        for path in itertools.product((0, 1), repeat=n):
            score = sum(u for u, y in zip(odds, path) if y) + sum(
                moves[a][b] for a, b in zip(path, path[1:]))
            weight[path] = math.exp(score)
        total = sum(weight.values())
        got = q.LineModel(np.zeros(q.FEATURES), moves).marginals(odds)
        for i in range(n):
            want = sum(w for p, w in weight.items() if p[i]) / total
            assert got[i] == pytest.approx(want, abs=1e-9)


def test_fit_reaches_the_top_of_the_likelihood():
    """Small steps away from the fitted weights lower the penalised likelihood."""
    rng = np.random.default_rng(1)
    chains = []
    for _ in range(60):
        label = int(rng.integers(2))
        x = np.zeros((int(rng.integers(1, 5)), q.FEATURES))
        x[:, 0] = 1
        x[:, 1] = rng.normal(2 * label - 1, 1.5, len(x))
        chains.append((x, label))

    def value(w, m):
        total = 0.0
        for x, y in chains:
            u = x @ w
            z = [math.exp(sum(u[i] * p[i] for i in range(len(u))) + sum(
                m[a][b] for a, b in zip(p, p[1:]))) for p in itertools.product(
                    (0, 1), repeat=len(u))]
            own = y * u.sum() + (len(u) - 1) * m[y][y]
            total += (own - math.log(sum(z))) / len(u)
        return total / len(chains) - 1e-3 * ((w ** 2).sum() + np.square(m).sum())

    single = [c for c in chains if len(c[0]) == 1]
    model = q.fit_chains(single, rounds=600, rate=0.05)
    chains = single
    best = value(model.weights, np.array(model.moves))
    for i in (0, 1):
        for d in (-0.1, 0.1):
            w = model.weights.copy()
            w[i] += d
            assert value(w, np.array(model.moves)) < best


def test_measures():
    length, x = q.line_features("AB CD!! EF\n\n  \nfoo foo foo foo\n")
    assert length.tolist() == [10, 15] and x.shape == (2, q.FEATURES)
    assert x[0, 1] == 1 and x[1, 1] == 0 and x[1, 4] == 0.75
    assert q.line_features(None)[1].shape == q.line_features(" \n\t")[1].shape == (1, q.FEATURES)


def test_blocks_do_not_change_features(monkeypatch):
    text = "\n".join(f"Line {i} of words {i % 7}" for i in range(50))
    whole = q.line_features(text)
    monkeypatch.setattr(q, "BLOCK", 10)
    parts = q.line_features(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = q.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 500 and all(0 <= r.score <= 1 for r in rows)
    right = [r.predicted == r.quality for r in rows]
    assert np.mean(right) > 0.98
    good = [r.predicted for r in rows if r.quality == 1]
    assert np.mean(good) > 0.995


def test_edge_rows_and_fold(spark):
    good = [(i, "A plain line of words that reads well enough.\nAnd another follows it here.")
            for i in range(40)]
    bad = [(100 + i, "CLICK!! HERE!! NOW!! BUY!!\nBUY BUY BUY BUY BUY") for i in range(40)]
    odd = [(200, None), (201, ""), (202, " \n"), (203, "word " * 40_000), (None, "x"),
           (0, good[0][1])]
    df = spark.createDataFrame([(d, t, 0.5, "l") for d, t in good + bad + odd],
                               "doc_id long, text string, score double, lang string")
    labels = spark.createDataFrame(
        [(d, 1) for d, _ in good] + [(d, 0) for d, _ in bad] + [(None, 1), (5, None), (6, 7)],
        "doc_id long, quality int")
    out = q.classify(df, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == df.count()
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    by = {r.doc_id: r for r in rows}
    assert by[3].predicted == 1 and by[103].predicted == 0
    kept = q.keep_good(df, labels)
    assert kept.columns == df.columns and kept.filter("doc_id = 103").isEmpty()
    assert q.classify(df.limit(0), labels).count() == 0
    assert {r.score for r in q.classify(df, labels.limit(0)).collect()} == {0.5}
