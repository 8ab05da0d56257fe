"""Ordered derivations that stay balanced when one key holds most of the rows.

A plain window over ``partitionBy(key)`` sends a whole key to one task.  Here the
order axis is cut into *slots*; each (key, slot) is windowed on its own, the slots
are reduced to one row each, the small slot table is scanned per key, and its result
is joined back.  The results equal the plain window's.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT = "__slot"


def _slot_frame(inclusive: bool, last: int | None = None):
    end = Window.currentRow if inclusive else -1
    return Window.unboundedPreceding, end


def carry(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slot: Column,
    values: Mapping[str, Column],
    *,
    inclusive: bool = True,
    backward: bool = False,
) -> DataFrame:
    """Last non-null value at or before each row (next one when ``backward``).

    ``order`` must be a total order within a key and ``slot`` a non-decreasing function
    of it.  A value that is null at a row is not carried from there.
    """
    keys = list(keys)
    stamp = F.struct(*[F.col(c) for c in order])
    base = df.withColumn(SLOT, slot)
    tmp = {f"__v{i}": (name, expr) for i, (name, expr) in enumerate(values.items())}
    for column, (_, expr) in tmp.items():
        base = base.withColumn(column, expr)

    direction = [F.col(c).desc() if backward else F.col(c).asc() for c in order]
    near = Window.partitionBy(*keys, SLOT).orderBy(*direction).rowsBetween(
        *_slot_frame(inclusive))
    edge = F.min_by if backward else F.max_by
    summary = base.groupBy(*keys, SLOT).agg(*[
        edge(F.col(c), F.when(F.col(c).isNotNull(), stamp)).alias(c) for c in tmp])
    far = Window.partitionBy(*keys).orderBy(
        F.col(SLOT).desc() if backward else F.col(SLOT).asc()
    ).rowsBetween(Window.unboundedPreceding, -1)
    before = summary.select(*keys, SLOT, *[
        F.last(c, ignorenulls=True).over(far).alias(f"{c}_far") for c in tmp])

    local = base.select("*", *[
        F.last(c, ignorenulls=True).over(near).alias(f"{c}_near") for c in tmp])
    joined = local.join(before, [*keys, SLOT], "left")
    kept = [F.col(c) for c in df.columns if c not in values]
    return joined.select(*kept, *[
        F.coalesce(f"{c}_near", f"{c}_far").alias(name) for c, (name, _) in tmp.items()])


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slot: Column,
    values: Mapping[str, Column],
    *,
    inclusive: bool = True,
) -> DataFrame:
    """Running totals per key; ``inclusive=False`` leaves the current row out."""
    keys = list(keys)
    base = df.withColumn(SLOT, slot)
    tmp = {f"__v{i}": (name, expr) for i, (name, expr) in enumerate(values.items())}
    for column, (_, expr) in tmp.items():
        base = base.withColumn(column, expr)
    near = Window.partitionBy(*keys, SLOT).orderBy(*order).rowsBetween(
        *_slot_frame(inclusive))
    summary = base.groupBy(*keys, SLOT).agg(*[F.sum(c).alias(c) for c in tmp])
    far = Window.partitionBy(*keys).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
    before = summary.select(*keys, SLOT, *[F.sum(c).over(far).alias(f"{c}_far") for c in tmp])
    local = base.select("*", *[F.sum(c).over(near).alias(f"{c}_near") for c in tmp])
    joined = local.join(before, [*keys, SLOT], "left")
    kept = [F.col(c) for c in df.columns if c not in values]
    zero = F.lit(0)
    return joined.select(*kept, *[
        (F.coalesce(f"{c}_near", zero) + F.coalesce(f"{c}_far", zero)).alias(name)
        for c, (name, _) in tmp.items()])


def positions(df, keys, order, slot, name: str = "pos") -> DataFrame:
    """0-based position of each row within its key."""
    return running_sum(df, keys, order, slot, {name: F.lit(1)}, inclusive=False)


def trailing_count(
    df: DataFrame, keys: Sequence[str], micros: str, window_micros: int, name: str,
    *, include_edge: bool = True,
) -> DataFrame:
    """Rows of the key in the trailing window that ends at each row.

    Rows are binned by the window's own width and copied into the following bin, so a
    bin holds everything its rows can see and a busy key spreads over its bins.
    ``include_edge`` keeps rows aged exactly one window.
    """
    bin_no = F.floor(F.col(micros) / F.lit(window_micros))
    copies = df.withColumn("__copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "__bin", bin_no + F.col("__copy"))
    reach = window_micros if include_edge else window_micros - 1
    frame = Window.partitionBy(*keys, "__bin").orderBy(micros).rangeBetween(-reach, 0)
    counted = copies.withColumn(name, F.count("*").over(frame))
    return counted.filter("__copy = 0").drop("__copy", "__bin")


def recent_n(df: DataFrame, keys: Sequence[str], newest_first: Sequence[Column], n: int,
             rank: str = "recency") -> DataFrame:
    """The ``n`` newest rows per key.

    ``row_number() <= n`` lets Spark cut each key to ``n`` rows in every map task before
    the shuffle, so the size of a key does not matter.
    """
    w = Window.partitionBy(*keys).orderBy(*newest_first)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def first_wins(df: DataFrame, keys: Sequence[str], load_order: Sequence[Column]) -> DataFrame:
    """The first row of each key in load order (also cut map-side)."""
    return recent_n(df, keys, load_order, 1, "__first").drop("__first")


def sessions(df: DataFrame, keys: Sequence[str], micros: str, tie: str, gap_micros: int,
             slot_micros: int) -> DataFrame:
    """Rows labelled with the start of their inactivity session.

    A new session opens when the pause *exceeds* the gap, so a pause equal to the gap
    continues the session.
    """
    slot = F.floor(F.col(micros) / F.lit(slot_micros))
    order = [micros, tie]
    with_prev = carry(df, keys, order, slot, {"__prev": F.col(micros)}, inclusive=False)
    opens = F.col("__prev").isNull() | (F.col(micros) - F.col("__prev") > gap_micros)
    return carry(with_prev, keys, order, slot,
                 {"session_start": F.when(opens, F.col(micros))}).drop("__prev")


def previous_window(df: DataFrame, keys: Sequence[str], order: Sequence[str], slot: Column,
                    value: str, n: int, name: str) -> DataFrame:
    """Array of the last ``n`` values strictly before each row, oldest first."""
    keys = list(keys)
    base = df.withColumn(SLOT, slot)
    near = Window.partitionBy(*keys, SLOT).orderBy(*order).rowsBetween(-n, -1)
    tail = recent_n(base.select(*keys, SLOT, *order, value), [*keys, SLOT],
                    [F.col(c).desc() for c in order], n, "__age")
    tails = tail.groupBy(*keys, SLOT).agg(F.transform(
        F.array_sort(F.collect_list(F.struct(-F.col("__age"), F.col(value).alias("v")))),
        lambda s: s["v"]).alias("__tail"))
    # Every slot listed holds a value, so the n slots before it hold the n values needed.
    far = Window.partitionBy(*keys).orderBy(SLOT).rowsBetween(-n, -1)
    before = tails.select(*keys, SLOT, F.flatten(F.collect_list("__tail").over(far)).alias("__far"))
    local = base.withColumn("__near", F.collect_list(value).over(near))
    joined = local.join(before, [*keys, SLOT], "left")
    both = F.concat(F.coalesce("__far", F.array().cast("array<string>")), F.col("__near"))
    size = F.size(both)
    return joined.withColumn(
        name, F.slice(both, F.greatest(size - n + 1, F.lit(1)), F.lit(n))
    ).drop(SLOT, "__far", "__near")


def take_budget(df: DataFrame, keys: Sequence[str], order: Sequence[str], slot: Column,
                size: Column, budget: int) -> DataFrame:
    """Leading rows of each key whose running size stays in the budget; the first always."""
    totals = running_sum(df, keys, order, slot, {"running": size, "__n": F.lit(1)})
    return totals.filter((F.col("running") <= budget) | (F.col("__n") == 1)).drop("__n")
