"""Steps of the streaming folds, replayed with chosen clocks."""

import time

import pytest
from pyspark.sql.types import StructType

from foliant.plans import QUERIES
from foliant.streaming import jobs as J
from foliant.streaming import stateful as ST

S = ST.SECOND
SF = "/root/testdata/sf0.001"


def stamps(*seconds, **extra):
    return [{"us": int(s * S), "seq": i, **extra} for i, s in enumerate(seconds)]


def test_sliding_limit_ignores_refused_events():
    out = ST.replay(stamps(0, 1, 2, 3, 10, 10.5, 12.5), ST.sliding_limit(3, 10 * S))
    # three admitted, one refused, the edge still counts at exactly one window
    assert [r["admitted"] for r in out] == [True, True, True, False, False, True, True]


def test_burst_guard():
    step = ST.burst_guard()
    out = ST.replay(stamps(0, 1, 2, 2.4, 5, 6, 60, 100, user_id=1), step)
    assert [r["verdict"] for r in out] == [
        "admitted", "cooldown", "cooldown", "cooldown", "admitted", "cooldown", "blocked", "admitted"]
    crowd = [{"us": i * S // 10, "seq": i, "user_id": i} for i in range(10)]
    assert [r["verdict"] for r in ST.replay(crowd, step)] == ["admitted"] * 8 + ["channel"] * 2


def test_strike_level_window_edge():
    out = ST.replay(stamps(0, 3600, 3601, 7300), ST.strike_level(3600 * S))
    assert [r["level"] for r in out] == [0, 1, 1, 0]


def test_session_memory():
    out = ST.replay(stamps(0, 1800, 3601, 3602), ST.session_memory(1800 * S, pairs=1))
    assert [(r["session_start"] // S, r["turn"], r["remembered"]) for r in out] == [
        (0, 1, 1), (0, 2, 2), (3601, 1, 1), (3601, 2, 2)]


def test_hostile_session():
    flags = [("i",), ("i",), ("i",), (), ("s",), (), ("p",), ()]
    rows = [{"us": i, "seq": i, "insult": "i" in f, "probe": "p" in f, "sincere": "s" in f}
            for i, f in enumerate(flags)]
    out = ST.replay(rows, ST.hostile_session())
    assert [r["hostile"] for r in out] == [False, False, False, True, True, False, False, True]


def test_last_value():
    rows = [{"us": i, "seq": i, "named": n} for i, n in enumerate(["Ana", None, "Bob", None])]
    assert [r["referent"] for r in ST.replay(rows, ST.last_value("named", "referent"))] == [
        None, "Ana", "Ana", "Bob"]


STEPS = {
    "limit": (ST.sliding_limit(2, 20 * S), "admitted boolean", 20 * S),
    "strikes": (ST.strike_level(30 * S), "level long", 30 * S),
    "sessions": (ST.session_memory(15 * S), "session_start long, turn long, remembered long",
                 15 * S),
    "hostile": (ST.hostile_session(), "insults long, hostile boolean", None),
    "referent": (ST.last_value("named", "referent"), "referent string", None),
}


@pytest.mark.parametrize("name", STEPS)
def test_shuffled_files_equal_replay(spark, tmp_path, name):
    """Files that land in any order, one a trigger, give what a replay in event order gives."""
    import random

    step, columns, idle = STEPS[name]
    rng = random.Random(2)
    schema = ("user_id long, us long, seq long, insult boolean, probe boolean, sincere boolean, "
              "named string")
    rows = [(rng.randint(1, 3), (10_000 + 4 * rng.randint(0, 100)) * S, t, rng.random() < .3,
             rng.random() < .1, rng.random() < .2, rng.choice([None, "Ana", "Bob"]))
            for t in range(120)]
    files = 5
    for part in range(files):
        spark.createDataFrame(rows[part::files], schema).coalesce(1).write.mode(
            "append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(
        f"{tmp_path}/in")
    out = StructType.fromDDL(f"user_id long, us long, seq long, {columns}")
    closed, ring = J.with_closing(stream)
    late = []
    got = J.run_to_end(ST.fold_stream(closed, "user_id", step, out, "2 hours", idle), ring=ring,
                       late=late)
    names = schema.replace(" long", "").replace(" boolean", "").replace(" string", "").split(", ")
    want = []
    for user in (1, 2, 3):
        mine = sorted((dict(zip(names, r)) for r in rows if r[0] == user),
                      key=lambda r: (r["us"], r["seq"]))
        want += [tuple(r.get(c) for c in out.names) for r in ST.replay(mine, step)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(late) == 0


def test_rows_beyond_the_delay_are_counted(spark, tmp_path):
    schema = "user_id long, us long, seq long"
    for n, seconds in enumerate((1000, 2000, 5, 3000)):  # the third is far too late
        spark.createDataFrame([(1, seconds * S, n)], schema).coalesce(1).write.mode(
            "append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files are taken in order of their time
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(
        f"{tmp_path}/in")
    closed, ring = J.with_closing(stream)
    late, out = [], StructType.fromDDL("user_id long, us long, seq long, level long")
    got = J.run_to_end(ST.fold_stream(closed, "user_id", ST.strike_level(5000 * S), out,
                                      "10 seconds"), ring=ring, late=late)
    assert sorted((r.seq, r.level) for r in got.collect()) == [(0, 0), (1, 1), (3, 2)]
    assert sum(late) == 1


def test_idle_state_is_cleared_without_a_trace():
    """A state as old as the rule remembers is as good as none."""
    for step, _, idle in list(STEPS.values())[:3]:
        rows = stamps(0, 1, 2, 3, 3 + idle / S + 0.001, user_id=1)
        assert ST.replay(rows, step)[-1] == ST.replay(rows[-1:], step)[0]


def test_redelivered_files_change_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(u, (100 + i) * S, 10 * u + i) for u in (1, 2) for i in range(5)],
                                 "user_id long, us long, seq long")
    for _ in range(2):
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(
        f"{tmp_path}/in")
    got = J.run_snapshots(J.once_each(stream, ["seq"], "1 hour"), J.merge_activity)
    assert {(r.user_id, r.msg_count) for r in got.collect()} == {(1, 5), (2, 5)}


@pytest.mark.parametrize("name", [
    "stream_limiter", "stream_strikes", "stream_sessions", "stream_activity", "stream_feedback",
    "stream_hostile", "stream_referent", "stream_burst_guard"])
def test_folder_tables_are_read_whole(spark, tmp_path, name):
    """A table of many part files gives the rows that the same table in one file gives."""
    for table in ("events", "conversations"):
        spark.read.parquet(f"{SF}/{table}.parquet").repartition(12).write.parquet(
            f"{tmp_path}/{table}.parquet")
    whole = sorted(map(tuple, QUERIES[name](spark, SF).collect()), key=repr)
    parts = sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()), key=repr)
    assert parts == whole and len(whole) > 10


def test_no_row_is_too_late(spark, tmp_path):
    """Long and short conversations, a file and so a micro-batch each: none is lost."""
    sizes = [100, 10, 10]
    for conv, turns in enumerate(sizes):
        spark.createDataFrame([(conv, t, "user", "Something") for t in range(turns)],
                              "conv_id long, turn long, role string, text string").coalesce(
            1).write.mode("append").parquet(f"{tmp_path}/conversations.parquet")
    stream = J.table_stream(spark, str(tmp_path), "conversations", 1).selectExpr(
        "conv_id", "turn as us", "turn as seq", "text as named")
    closed, ring = J.with_closing(stream)
    out = ST.fold_stream(closed, "conv_id", ST.last_value("named", "referent"), StructType.fromDDL(
        "conv_id long, seq long, referent string"))
    rows = J.run_to_end(out, ring=ring).groupBy("conv_id").count().collect()
    assert {r.conv_id: r["count"] for r in rows} == dict(enumerate(sizes))


def test_a_busy_channel_is_not_swept_for_each_row():
    """Work of the guard for each row, by the users that it looks at."""
    looks = 0

    class Seen(list):
        def __getitem__(self, i):
            nonlocal looks
            looks += 1
            return super().__getitem__(i)

    step, state, n = ST.burst_guard(), {}, 2000
    for i in range(n):
        state, _ = step(state, {"us": i * S // 20, "seq": i, "user_id": i})
        state["users"][str(i)] = Seen(state["users"][str(i)])
    assert looks <= 10 * n


def test_rows_of_a_key_wait_in_chunks(spark, tmp_path, monkeypatch):
    """Chunks of three rows, merged over files and cut by the watermark, give what a replay gives."""
    monkeypatch.setattr(ST, "CHUNK", 3)
    rows = [(u, (1000 + 7 * (i * 5 % 23)) * S, 100 * u + i) for u in (1, 2, 3) for i in range(23)]
    rows.sort(key=lambda r: r[1:])
    part = [min(2, 3 * i // len(rows) + i % 2) for i in range(len(rows))]
    for file in range(3):
        spark.createDataFrame([r for r, at in zip(rows, part) if at == file],
                              "user_id long, us long, seq long").coalesce(
            1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files are taken in order of their time
    stream = spark.readStream.schema("user_id long, us long, seq long").option(
        "maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    closed, ring = J.with_closing(stream)
    fold = ST.fold_stream(closed, "user_id", ST.strike_level(40 * S), StructType.fromDDL(
        "user_id long, us long, seq long, level long"), "110 seconds", 40 * S)
    # The groups of the stream are buckets, however many keys there are.
    assert "bucket" in fold._jdf.queryExecution().analyzed().toString()
    late = []
    got = J.run_to_end(fold, ring=ring, late=late).collect()
    assert sum(late) == 0
    want = []
    for user in (1, 2, 3):
        mine = sorted(({"user_id": u, "us": t, "seq": q} for u, t, q in rows if u == user),
                      key=lambda r: (r["us"], r["seq"]))
        want += [(r["user_id"], r["us"], r["seq"], r["level"])
                 for r in ST.replay(mine, ST.strike_level(40 * S))]
    assert sorted(map(tuple, got)) == sorted(want)
