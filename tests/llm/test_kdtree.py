"""Exact top-k against scoring every pair."""

import math

import numpy as np
import pytest

from foliant.llm import kdtree_topk as t


def slow_top(rows, k=5, every=50):
    clean = []
    for vec_id, x in rows:
        if vec_id is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        clean.append((vec_id, [math.floor(256 * float(np.float32(c))) for c in x]))
    out = []
    for n, (q, a) in enumerate(clean):
        if q % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(clean)
                        if m != n and len(b) == len(a))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("limits", [(8192, 4096, 64), (60, 3, 4)])
def test_against_all_pairs(spark, monkeypatch, limits):
    for name, value in zip(("SHARD_ROWS", "QUERY_ROWS", "LEAF"), limits):
        monkeypatch.setattr(t, name, value)
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(600)]
    rows += [(i, rng.integers(-1, 2, 6).astype(float).tolist()) for i in range(600, 800)]  # ties
    rows += [(800, [1.0] * 6)] + [(801 + i, [0.5] * 6) for i in range(20)]
    rows += [(850, None), (851, [None] * 6), (900, [float("nan")] * 6), (901, [float("inf")] * 6),
             (None, [9.0] * 6), (950, [1.0, 2.0]), (951, [3.0, 1.0]), (1000, []), (1001, []),
             (50, rows[50][1]), (51, [-9.0] + [0.0] * 5), (1050, [5.0] * 7), (-50, [1.5] * 6),
             (100, [2.0, 1.0] * 3), (100, [0.5, 1.0] * 3), (1100, [-1e-20, 1e-30] * 3),
             (1101, [-1e-20] * 6)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows],
                               "vec_id long, embedding array<float>, rank int, score int")
    out = t.top_k(df.repartition(4))
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, out.collect())) == slow_top(rows)
    assert t.top_k(df.limit(0)).count() == 0


def test_boxes_are_tight_and_prune(monkeypatch):
    rng = np.random.default_rng(1)
    vectors = np.floor(256 * rng.normal(size=(3000, 3)))
    tree = t.build(vectors)
    for node, left in enumerate(tree.left):
        part = vectors[tree.order[tree.start[node]:tree.stop[node]]]
        assert (part.min(0) == tree.low[node]).all() and (part.max(0) == tree.high[node]).all()
        if left:
            sizes = [tree.stop[c] - tree.start[c] for c in (left, tree.right[node])]
            assert abs(sizes[0] - sizes[1]) <= 1
    assert sorted(tree.order.tolist()) == list(range(3000))
    looked = []
    plain = t._products
    monkeypatch.setattr(t, "_products", lambda a, b: looked.append(len(b)) or plain(a, b))
    rows = np.arange(3000)
    list(t.search(rows, rows, vectors, np.array([0]), vectors[:1], [None]))
    assert sum(looked[2:]) < 1500


def test_large_components_stay_exact(spark):
    rows = [(0, [3e18, 1.0]), (50, [3e14, 7.0]), (1, [3e14, 1.0]), (2, [3e14, 1.5]),
            (3, [-2e18, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")

    def whole(x):
        return [math.floor(256 * c) for c in x]

    want = []
    for q in (0, 50):
        scored = sorted((-sum(a * b for a, b in zip(whole(dict(rows)[q]), whole(x))), i)
                        for i, x in rows if i != q)
        want += [(q, i, max(-2**63, min(2**63 - 1, -s))) for s, i in scored]
    got = [(r.query_id, r.vec_id, r.score) for r in t.top_k(df).collect()]
    assert sorted(got) == sorted(want)
