"""Streaming runs over the event and conversation tables, with batch twins as checks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from foliant import staging
from foliant.functions import classify as C
from foliant.operators import export
from foliant.plans import sql as S
from foliant.plans.classify import _MARKS
from foliant.plans.registry import query
from foliant.schemas import epoch_micros
from foliant.sources import files as FS
from foliant.streaming import jobs as J
from foliant.streaming import stateful as ST

_LONG, _STR, _BOOL = LongType(), StringType(), BooleanType()


def _schema(**cols):
    return StructType([StructField(n, t) for n, t in cols.items()])


def event_stream(spark, sf):
    return J.table_stream(spark, sf, "events").select(
        "user_id", "event_type", epoch_micros("ts").alias("us"), F.col("event_id").alias("seq"),
        "value", "props")


def _folded(events, key, step, schema, idle_us=None):
    """The fold of a whole table, whatever the order of its files."""
    rows, ring = J.with_closing(events)
    return J.run_to_end(ST.fold_stream(rows, key, step, schema, idle_us=idle_us), ring=ring)


@query("stream_limiter")
def stream_limiter(spark, sf):
    """Admission of each event under a limit of three per client and twelve hours."""
    ev = event_stream(spark, sf).select("user_id", "us", "seq")
    out = _schema(user_id=_LONG, us=_LONG, seq=_LONG, admitted=_BOOL)
    window = 12 * 3600 * ST.SECOND
    return _folded(ev, "user_id", ST.sliding_limit(3, window), out, window)


@query("stream_burst_guard")
def stream_burst_guard(spark, sf):
    """Verdict of the burst guard for each event; the event type stands in for the channel."""
    ev = event_stream(spark, sf).select("event_type", "user_id", "us", "seq")
    out = _schema(event_type=_STR, user_id=_LONG, us=_LONG, seq=_LONG, verdict=_STR)
    guard = ST.burst_guard(cooldown_us=1800 * ST.SECOND, channel_limit=8,
                           channel_window_us=5400 * ST.SECOND,
                           penalty_window_us=7200 * ST.SECOND, block_us=7200 * ST.SECOND)
    return _folded(ev, "event_type", guard, out, 14_400 * ST.SECOND)


@query("stream_strikes", f"""
WITH {S.EV}, s AS (SELECT * FROM ev WHERE event_type = 'error')
SELECT user_id, us, event_id AS seq, count(*) OVER (PARTITION BY user_id ORDER BY us
  RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) - 1 AS level FROM s""")
def stream_strikes(spark, sf):
    ev = event_stream(spark, sf).filter("event_type = 'error'").select("user_id", "us", "seq")
    out = _schema(user_id=_LONG, us=_LONG, seq=_LONG, level=_LONG)
    window = 86_400 * ST.SECOND
    return _folded(ev, "user_id", ST.strike_level(window), out, window)


@query("stream_sessions", f"""
WITH {S.EV}, a AS (SELECT user_id, event_id, us,
  us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS gap FROM ev),
b AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 43200000000 THEN 1 ELSE 0 END)
  OVER (PARTITION BY user_id ORDER BY us, event_id) AS no FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id, no ORDER BY us, event_id) AS turn FROM b)
SELECT user_id, us, event_id AS seq, min(us) OVER (PARTITION BY user_id, no) AS session_start, turn,
  least(turn, 8) AS remembered FROM c""")
def stream_sessions(spark, sf):
    ev = event_stream(spark, sf).select("user_id", "us", "seq")
    out = _schema(user_id=_LONG, us=_LONG, seq=_LONG, session_start=_LONG, turn=_LONG,
                  remembered=_LONG)
    gap = 12 * 3600 * ST.SECOND
    return _folded(ev, "user_id", ST.session_memory(gap), out, gap)


@query("stream_activity", f"""
WITH {S.EV} SELECT user_id, count(*) AS msg_count, min(us) AS first_seen, max(us) AS last_seen
FROM ev GROUP BY user_id""")
def stream_activity(spark, sf):
    return J.run_snapshots(J.once_each(event_stream(spark, sf), ["seq"], ST.REPLAY),
                           J.merge_activity)


@query("stream_feedback", """
SELECT user_id, key, arg_max(verdict, (us, event_id)) AS verdict FROM (
  SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS key, epoch_us(ts) AS us, event_id,
    CASE event_type WHEN 'click' THEN 'up' WHEN 'error' THEN 'down' ELSE event_type END AS verdict
  FROM events) WHERE verdict IN ('up', 'down') GROUP BY ALL""")
def stream_feedback(spark, sf):
    verdict = F.when(F.col("event_type") == "click", "up").when(
        F.col("event_type") == "error", "down").otherwise(F.col("event_type"))
    feedback = event_stream(spark, sf).select(
        "user_id", F.get_json_object("props", "$.k").cast("long").alias("key"), "us",
        F.col("seq").alias("event_id"), verdict.alias("verdict"))
    return J.run_snapshots(J.once_each(feedback, ["event_id"], ST.REPLAY),
                           J.merge_feedback(["user_id", "key"]))


def turn_stream(spark, sf):
    """Conversation turns as a stream, ordered by turn within a conversation only."""
    t = J.table_stream(spark, sf, "conversations")
    return t.withColumn("us", F.col("turn")).withColumn("seq", F.col("turn"))


@query("stream_hostile", f"""
WITH {_MARKS} SELECT conv_id, turn AS seq, insults::BIGINT AS insults, coalesce(prior = 'open', false) AS hostile FROM h""")
def stream_hostile(spark, sf):
    from foliant.plans.classify import OPENINGS, opening
    i = F.col("conv_id") * 7 + F.col("turn")
    said = F.concat(opening(i), F.when(
        (i % len(OPENINGS)).isin(13, 18), F.lit("")).otherwise(F.col("text")))
    m = F.col("m")
    turns = turn_stream(spark, sf).select(
        "conv_id", "us", "seq", F.lower(said).alias("m")).select(
        "conv_id", "us", "seq", C.is_probe(m).alias("probe"), C.is_insult(m).alias("insult"),
        C.is_sincere_apology(m).alias("sincere"))
    out = _schema(conv_id=_LONG, seq=_LONG, insults=_LONG, hostile=_BOOL)
    return _folded(turns, "conv_id", ST.hostile_session(), out)


@query("stream_referent", """
WITH r AS (SELECT conv_id, turn, nullif(regexp_extract(text, '(?:^|[^A-Za-zÀ-ÿ])([A-ZÀ-Ý][a-zà-ÿ]{5,})', 1), '')
  AS named FROM conversations)
SELECT conv_id, turn AS seq, last_value(named IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS referent FROM r""")
def stream_referent(spark, sf):
    named = F.nullif(F.regexp_extract(
        "text", r"(?:^|[^A-Za-zÀ-ÿ])([A-ZÀ-Ý][a-zà-ÿ]{5,})", 1), F.lit(""))
    turns = turn_stream(spark, sf).select("conv_id", "us", "seq", named.alias("named"))
    out = _schema(conv_id=_LONG, seq=_LONG, referent=_STR)
    return _folded(turns, "conv_id", ST.last_value("named", "referent"), out)


@query("stream_new_files", f"""
WITH {S.PAGES_MD} SELECT bucket_id, count(*) AS pages FROM pages_md GROUP BY bucket_id""")
def stream_new_files(spark, sf):
    """Bucket documents picked up by the file stream as they land."""
    pages = staging.pages_md(spark, sf).drop("lang")
    docs = export.megafile_documents(pages, export.megafile_parts(pages, 100), "2024-01-01T00:00:00Z")
    path = FS.scratch_dir(spark, "landing")
    docs.select("document").write.text(path)
    landed = spark.readStream.text(path)
    from foliant.schemas import MEGAFILE
    seen = landed.select(F.from_json("value", MEGAFILE).alias("d")).select(
        F.col("d.metadata.bucket_title").alias("bucket_id"),
        F.col("d.metadata.total_pages").alias("pages"))
    return J.run_to_end(seen).groupBy("bucket_id").agg(F.sum("pages").alias("pages"))


