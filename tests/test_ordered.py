"""Balanced ordered scans equal plain windows, hot key included."""

import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.operators import dialogue, members, ordered, packing
from foliant.operators.packing import pack


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = [(0, i, rng.choice([None, f"v{i}"]), rng.randint(0, 9)) for i in range(900)]
    data += [(k, i * 3, rng.choice([None, "x"]), 1) for k in range(1, 12) for i in range(rng.randint(1, 20))]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k int, i int, v string, n int").cache()


def same(a, b):
    assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(
        map(str, b.select(sorted(b.columns)).collect()))


def slot():
    return F.floor(F.col("i") / 7)


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("backward", [True, False])
def test_carry(rows, inclusive, backward):
    got = ordered.carry(rows, ["k"], ["i"], slot(), {"c": F.col("v")}, inclusive=inclusive,
                        backward=backward)
    w = Window.partitionBy("k").orderBy(F.col("i").desc() if backward else "i").rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    same(got, rows.withColumn("c", F.last("v", True).over(w)))


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_sum(rows, inclusive):
    got = ordered.running_sum(rows, ["k"], ["i"], slot(), {"s": F.col("n")}, inclusive=inclusive)
    w = Window.partitionBy("k").orderBy("i").rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    same(got, rows.withColumn("s", F.coalesce(F.sum("n").over(w), F.lit(0))))


def test_previous_window(rows):
    d = rows.filter("v IS NOT NULL")
    got = ordered.previous_window(d, ["k"], ["i"], slot(), "v", 3, "h")
    w = Window.partitionBy("k").orderBy("i").rowsBetween(-3, -1)
    same(got, d.withColumn("h", F.collect_list("v").over(w)))


def test_trailing_count_edges(spark):
    d = spark.createDataFrame([(1, t) for t in (0, 5, 10, 10, 20, 31)], "u int, us long")
    inc = ordered.trailing_count(d, ["u"], "us", 10, "n").groupBy("us").agg(F.max("n").alias("n"))
    exc = ordered.trailing_count(d, ["u"], "us", 10, "n", include_edge=False).groupBy("us").agg(
        F.max("n").alias("n"))
    assert {r.us: r.n for r in inc.collect()} == {0: 1, 5: 2, 10: 4, 20: 3, 31: 1}
    assert {r.us: r.n for r in exc.collect()} == {0: 1, 5: 2, 10: 3, 20: 1, 31: 1}


def test_sessions_continue_at_the_exact_gap(spark):
    d = spark.createDataFrame([(1, i, t) for i, t in enumerate((0, 10, 20, 31, 41))],
                              "user_id int, event_id int, us long")
    got = members.inactivity_sessions(d, gap_us=10).orderBy("session_start").collect()
    assert [(r.session_start, r.messages) for r in got] == [(0, 3), (31, 2)]


def _plain_groups(data, budget):
    want = {}
    for k in {d[0] for d in data}:
        size = group = None
        for _, i, s in sorted(d for d in data if d[0] == k):
            if size is None:
                size, group = s, 0
            elif size + s > budget:
                size, group = s, group + 1
            else:
                size += s
            want[k, i] = group
    return want


@pytest.mark.parametrize("fan", [2, 64])
@pytest.mark.parametrize("budget", [1, 10, 100, 5000])
def test_pack_equals_a_plain_loop(spark, monkeypatch, budget, fan):
    monkeypatch.setattr(packing, "FAN", fan)
    rng = random.Random(budget)
    data = [(0, i, rng.choice([0, 1, 3, 7, 20, 150])) for i in range(2500)]
    data += [(k, i, rng.randint(0, 40)) for k in range(1, 6) for i in range(rng.randint(1, 60))]
    rng.shuffle(data)
    got = {(r.k, r.i): r.group_no for r in pack(
        spark.createDataFrame(data, "k int, i int, s int"), ["k"], ["i"], F.col("s"), budget).collect()}
    assert got == _plain_groups(data, budget)


def test_pack_of_nothing(spark):
    empty = spark.createDataFrame([], "k int, i int, s int")
    assert pack(empty, ["k"], ["i"], F.col("s"), 10).collect() == []


@pytest.mark.parametrize("budget", [0, 1, 10, 100, 5000])
@pytest.mark.parametrize("hot", [True, False])
def test_summaries_of_two_thousand_partitions_compose(budget, hot):
    """Trees of several fans tell every partition the state that a plain loop has there."""
    rng = random.Random(budget)
    data = [(0 if hot else rng.choice([0, 0, 0, 1]) + i // 500, i, rng.choice([0, 0, 1, 3, 7, 150]))
            for i in range(6000)]
    data.sort()
    cuts = sorted(rng.sample(range(1, len(data)), 1999))
    parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]
    want, plain = {}, _plain_groups(data, budget)
    for pid, (before, part) in enumerate(zip(parts, parts[1:]), 1):
        k, i, _ = before[-1]
        if part[0][0] == k:
            open_size = sum(s for k2, i2, s in data if k2 == k and i2 <= i and plain[k2, i2] == plain[k, i]) \
                if pid % 50 == 0 else None
            want[pid] = (open_size, plain[k, i] + 1)
    frames = [pd.DataFrame({"__key": [str(k) for k, _, _ in p], "__size": [s for _, _, s in p],
                            "__pid": pid}) for pid, p in enumerate(parts)]
    summary = pd.concat([x for f in frames for x in packing._summaries(budget)(iter([f]))])
    for fan in (3, 64):
        levels = [summary]
        while len(levels[-1]) > fan:
            levels.append(pd.concat([packing._up(budget)((b,), g) for b, g in levels[-1].groupby(
                levels[-1]["pid"] // fan)]))
        state = pd.DataFrame({"pid": [], "open_size": [], "groups": []})
        for level in reversed(levels):
            told = level.assign(block=level["pid"] // fan).merge(
                state.rename(columns={"pid": "block"}), "left", "block")
            state = pd.concat([packing._down(budget)(g) for _, g in told.groupby("block")])
        got = {int(r.pid): (r.open_size, r.groups) for r in state.itertuples()}
        assert set(got) == set(want)
        for pid, (open_size, groups) in want.items():
            assert got[pid][1] == groups and open_size in (None, got[pid][0])
        # A table never holds more rows than fit into one budget, and one more.
        assert all(r.prefix is None or len(r.prefix) < 2 or r.prefix[-2] <= budget
                   for lv in levels for r in lv.itertuples())


def test_parent_links(spark):
    d = spark.createDataFrame(
        [(1, i, c) for i, c in enumerate([False, True, True, False, False, True, False])]
        + [(2, 0, True), (2, 1, False)], "page_id long, message_order long, player_choice boolean")
    got = {(r.page_id, r.message_order): r.parent_order for r in dialogue.parent_links(d).collect()}
    assert got == {(1, 0): None, (1, 1): 0, (1, 2): 0, (1, 3): 2, (1, 4): 3, (1, 5): 4, (1, 6): 5,
                   (2, 0): None, (2, 1): 0}


def test_conversation_graph_rules(spark):
    # npc, two choices, npc that ends, npc, choice
    spec = [(0, False, False), (1, True, False), (2, True, False), (3, False, True),
            (4, False, False), (5, True, False)]
    d = spark.createDataFrame([(1, *s) for s in spec],
                              "page_id long, message_order long, player_choice boolean, t boolean")
    got = {(r.source, r.target, r.rule) for r in dialogue.conversation_graph(d, F.col("t")).collect()}
    assert got == {(0, 1, "choice"), (0, 2, "choice"), (1, 3, "rejoin"), (2, 3, "rejoin"),
                   (4, 5, "choice")}
    nodes = d.select("page_id", F.col("message_order").alias("node"),
                     (F.col("message_order") == 0).alias("is_start"))
    edges = dialogue.conversation_graph(d, F.col("t"))
    assert {r.target for r in dialogue.attach_root(nodes, edges).collect()} == {0, 4}


def test_members(spark):
    ev = spark.createDataFrame([(u,) for u in [1] * 5 + [2] * 3 + [3] * 3 + [4]], "user_id int")
    got = {r.user_id: (r.percentile, r.label) for r in members.activity_percentile(ev).collect()}
    assert got == {1: (100, "Très assidu"), 2: (33, "Peu assidu"), 3: (33, "Peu assidu"),
                   4: (0, "Inactif")}
    alone = members.activity_percentile(ev.filter("user_id = 1")).collect()
    assert [r.label for r in alone] == ["Modéré"]
