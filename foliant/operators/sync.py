"""Incremental sync: what to fetch, what vanished, and the snapshots after an upsert.

Parquet has no MERGE.  Each upsert computes the next snapshot from the stored and the
incoming one; the caller writes it next to the old one and swaps.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accepts(title: Column, include: Sequence[str], exclude: Sequence[str]) -> Column:
    """Title filter of a bucket: any include word (or none asked), no exclude word."""
    low = F.lower(title)

    def has(words):
        return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w.lower())) for w in words])

    keep = has(include) if include else F.lit(True)
    return keep & ~has(exclude) if exclude else keep


def assign_bucket(title: Column, category: Column, specs: Sequence[Mapping]) -> Column:
    """First bucket, in configuration order, that takes the page; null when none does."""
    return F.coalesce(*[
        F.when(category.isin(*s["categories"])
               & accepts(title, s.get("include", ()), s.get("exclude", ())), F.lit(s["id"]))
        for s in specs])


def prefix_members(paths: DataFrame, prefix: str) -> DataFrame:
    """Titles below a prefix: neither the bare prefix, nor folders, nor file pages."""
    p = F.col("path")
    return paths.filter(
        F.startswith(p, F.lit(prefix)) & (p != prefix) & ~F.endswith(p, F.lit("/"))
        & ~F.contains(p, F.lit("/File:")))


def delta_plan(live: DataFrame, stored: DataFrame, keys: Sequence[str],
               force: bool = False) -> DataFrame:
    """Live rows to fetch, with the reason.

    ``live`` has touched and missing; ``stored`` has touched.
    """
    s = stored.select(*keys, F.col("touched").alias("stored_touched"), F.lit(True).alias("known"))
    j = live.filter("NOT missing").join(s, list(keys), "left")
    reason = (
        F.when(F.lit(force), "forced").when(F.col("touched").isNull(), "no_signal")
        .when(F.col("known").isNull(), "new")
        .when(~F.equal_null("touched", "stored_touched"), "changed"))
    return j.withColumn("reason", reason).filter("reason IS NOT NULL").select(
        *keys, "touched", "reason")


def vanished(stored: DataFrame, live: DataFrame, keys: Sequence[str], *,
             allow_empty: bool = True) -> DataFrame:
    """Stored rows absent from the live set.

    With an empty live set everything is gone; ``allow_empty=False`` keeps all rows then,
    as a guard against a source that answered nothing.
    """
    gone = stored.join(live.select(*keys).distinct(), list(keys), "left_anti")
    if allow_empty:
        return gone
    seen = live.limit(1).agg((F.count("*") > 0).alias("__seen"))  # one row
    return gone.join(F.broadcast(seen), F.col("__seen")).drop("__seen")


def reconcile(old: DataFrame, new: DataFrame, keys: Sequence[str],
              values: Sequence[str]) -> DataFrame:
    """Action per chunk: insert, update (its vector is void), keep or delete."""
    o = old.select(*keys, F.struct(*values).alias("o"))
    n = new.select(*keys, F.struct(*values).alias("n"))
    j = o.join(n, list(keys), "full_outer")
    action = (
        F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "delete")
        .when(F.equal_null("o", "n"), "keep").otherwise("update"))
    return j.select(*keys, action.alias("action"), *[
        F.coalesce(f"n.{v}", f"o.{v}").alias(v) for v in values])


def recreated(stored: DataFrame, incoming: DataFrame, title: str, page_id: str) -> DataFrame:
    """Stored pages whose title comes in under another id.

    The incoming side is folded to one row per title, so copies never multiply.
    """
    ids = incoming.groupBy(title).agg(F.min(page_id).alias("__lo"), F.max(page_id).alias("__hi"))
    return stored.join(ids, title).filter(
        (F.col("__lo") != F.col(page_id)) | (F.col("__hi") != F.col(page_id))
    ).drop("__lo", "__hi")


def cascade(children: Mapping[str, DataFrame], removed: DataFrame, page_id: str
            ) -> dict[str, DataFrame]:
    """Child tables without the rows of removed pages."""
    ids = removed.select(page_id).distinct()
    return {name: df.join(ids, page_id, "left_anti") for name, df in children.items()}


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], *,
           keep_stored: Sequence[str] = (), stamp: str | None = None, now: Column | None = None
           ) -> DataFrame:
    """Next snapshot: every column of an incoming row wins, ``keep_stored`` ones excepted.

    ``stamp`` names the column set to ``now`` on each touched row.
    """
    cols = [c for c in stored.columns if c not in keys]
    s = stored.select(*keys, F.struct(*cols).alias("s"))
    n = incoming.select(*keys, F.struct(*cols).alias("n"))
    j = s.join(n, list(keys), "full_outer")

    def pick(c):
        if c == stamp:
            return F.when(F.col("n").isNotNull(), now).otherwise(F.col(f"s.{c}"))
        if c in keep_stored:
            return F.when(F.col("s").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(f"n.{c}"))
        return F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"s.{c}"))

    return j.select(*keys, *[pick(c).alias(c) for c in cols])


def last_wins(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of snapshots in which a later one overrides an earlier one, key by key."""
    cols = [c for c in parts[0].columns if c not in keys]
    ranked = [p.select(*keys, F.lit(i).alias("__rank"), F.struct(*cols).alias("__row"))
              for i, p in enumerate(parts)]
    # max_by folds map-side, so a key repeated in every snapshot shuffles one row per task.
    merged = reduce(DataFrame.unionByName, ranked).groupBy(*keys).agg(
        F.max_by("__row", "__rank").alias("__row"))
    return merged.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in cols])


def first_priority(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union in which an earlier source is never overwritten by a later one."""
    return last_wins(list(reversed(parts)), keys)


def replace_pages(old: DataFrame, new: DataFrame, page_id: str, *,
                  empty_pages: DataFrame | None = None) -> DataFrame:
    """Derived rows after a per-page replace.

    Pages without new rows keep theirs; ``empty_pages`` lists pages derived to nothing,
    whose stale rows go too.
    """
    touched = new.select(page_id)
    if empty_pages is not None:
        touched = touched.unionByName(empty_pages.select(page_id))
    return old.join(touched.distinct(), page_id, "left_anti").unionByName(new)


def merge_megafile(existing: DataFrame, vanished_titles: DataFrame, new: DataFrame,
                   keys: Sequence[str]) -> DataFrame:
    """Existing pages minus the vanished ones, overwritten by the new ones."""
    kept = existing.join(vanished_titles.select(*keys).distinct(), list(keys), "left_anti")
    return last_wins([kept, new], keys)


# Caution order of the reliability status.
CAUTION = ("canon", "speculation", "community_theory")


def most_cautious(*statuses: Column) -> Column:
    """The weakest of several statuses."""
    order = F.array(*[F.lit(s) for s in CAUTION])
    ranks = [F.array_position(order, s) for s in statuses]
    worst = F.greatest(*ranks) if len(ranks) > 1 else ranks[0]
    return F.get(order, worst.cast("int") - 1)
