"""Activity, strikes, reliability and sessions of the members behind a message stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators import ordered

HOUR_US = 3_600_000_000
# Thresholds and labels of the activity tiers.
TIERS = ((80, "Très assidu"), (60, "Assidu"), (40, "Modéré"), (20, "Peu assidu"))


def activity_percentile(messages: DataFrame) -> DataFrame:
    """Share of the other members with fewer messages, as a label.

    Members are first folded into one row per distinct message count: at most √(2N) rows
    for N messages, so the cumulative scan over them and its broadcast stay small
    (10¹² messages give 1.4 million rows of two numbers).
    """
    counts = messages.groupBy("user_id").agg(F.count("*").alias("msg_count"))
    per_count = counts.groupBy("msg_count").agg(F.count("*").alias("members"))
    w = Window.orderBy("msg_count")
    ladder = per_count.select(
        "msg_count",
        F.coalesce(F.sum("members").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("behind"),
        F.sum("members").over(Window.partitionBy()).alias("total"))
    scored = counts.join(F.broadcast(ladder), "msg_count").withColumn(
        "percentile", F.bround(
            100.0 * F.col("behind") / F.nullif(F.col("total") - 1, F.lit(0))).cast("long"))
    label = F.when(F.col("total") == 1, "Modéré")
    for threshold, name in TIERS:
        label = label.when(F.col("percentile") >= threshold, name)
    return scored.select("user_id", "msg_count", "percentile",
                         label.otherwise("Inactif").alias("label"))


def reliability(activity: DataFrame, insolence: DataFrame, probes: DataFrame) -> DataFrame:
    """Reliability of each known member from activity and two strike counts."""

    def count(df, name):
        return df.groupBy("user_id").agg(F.count("*").alias(name))

    j = count(activity, "activity").join(count(insolence, "insolence"), "user_id", "full_outer"
        ).join(count(probes, "probes"), "user_id", "full_outer").na.fill(0)
    a, i, p = F.col("activity"), F.col("insolence"), F.col("probes")
    label = (
        F.when(p >= 2, "Compromis").when(i >= 3, "Défaillant").when(a == 0, "Inconnu")
        .when(a < 3, "Faible").when((a >= 10) & (i == 0) & (p == 0), "Élevée")
        .when(a >= 5, "Moyenne").otherwise("Inconstant"))
    return j.withColumn("reliability", label)


def strike_levels(strikes: DataFrame, window_us: int = HOUR_US) -> DataFrame:
    """Escalation level at each strike: strikes in the trailing window, minus one.

    ``level`` keeps a strike aged exactly one window; ``ledger_level`` drops it.
    """
    d = ordered.trailing_count(strikes, ["user_id"], "us", window_us, "__in")
    d = ordered.trailing_count(d, ["user_id"], "us", window_us, "__ex", include_edge=False)
    return d.withColumn("level", F.col("__in") - 1).withColumn(
        "ledger_level", F.col("__ex") - 1).drop("__in", "__ex")


def inactivity_sessions(messages: DataFrame, gap_us: int = HOUR_US // 2) -> DataFrame:
    """One row per session of each member."""
    labelled = ordered.sessions(messages, ["user_id"], "us", "event_id", gap_us, 24 * HOUR_US)
    return labelled.groupBy("user_id", "session_start").agg(
        F.count("*").alias("messages"), F.max("us").alias("session_end"))


def last_verdict(feedback: DataFrame, keys: list[str]) -> DataFrame:
    """Last verdict per key; verdicts outside the enumeration are ignored."""
    known = feedback.filter(F.col("verdict").isin("up", "down"))
    return known.groupBy(*keys).agg(
        F.max_by("verdict", F.struct("us", "event_id")).alias("verdict"))
