"""Greedy budgeted packing of ordered rows, balanced for keys of any size.

Rows join the open group until the next one would exceed the budget, then a group opens;
the first row of a group is always taken.  The sum resets at points that depend on
everything before, so no window frame expresses it.  Instead of folding a whole key in
one task, the rows are range-partitioned by (key, order): each partition is folded on its
own for every state it could be entered with, and a second pass numbers the groups.  What a
partition does to the state is a summary, and summaries of neighbours compose to a summary of the
same kind, so they are folded in a tree of a fixed fan: upwards to learn what whole runs of
partitions do, downwards to tell each partition the state in which it continues the key before it.
Only partitions of a single key carry a table, of as many rows as fit into one budget.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.session import materialize

_SUMMARY = ("pid int, first_key string, last_key string, single boolean, "
            "prefix array<double>, exit_size array<double>, started array<long>, total double, "
            "end_size double, end_started long")
_STATE = "pid int, open_size double, groups long"
FAN = 64  # summaries folded by one task


def _run_table(sizes: np.ndarray, budget: float):
    """Outcome of a run for each row at which its first group can open.

    Returns prefix sums, size left open at the end, and groups opened, up to the first
    row at which a group must open even if nothing was open before.
    """
    total = np.cumsum(sizes)
    before = total - sizes
    m = len(sizes)
    following = np.maximum(np.searchsorted(total, before + budget, side="right"),
                           np.arange(1, m + 1))
    exit_size, started = np.empty(m), np.empty(m, dtype=np.int64)
    for i in range(m - 1, -1, -1):
        j = following[i]
        if j >= m:
            exit_size[i], started[i] = total[-1] - before[i], 1
        else:
            exit_size[i], started[i] = exit_size[j], started[j] + 1
    last = min(int(np.searchsorted(total, budget, side="right")), m - 1)
    return total[:last + 1], exit_size[:last + 1], started[:last + 1], float(total[-1])


def _enter(prefix, exit_size, started, total, open_size, budget):
    """State after a run entered with ``open_size`` already in the open group."""
    at = int(np.searchsorted(np.asarray(prefix) + open_size, budget, side="right"))
    if at >= len(prefix):
        return open_size + total, 0
    return exit_size[at], started[at]


def _summaries(budget: float):
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, first, last = None, None, None
        tail: list[np.ndarray] = []
        for pdf in batches:
            if pdf.empty:
                continue
            keys, sizes = pdf["__key"].to_numpy(), pdf["__size"].to_numpy(dtype=float)
            if pid is None:
                pid, first, last = int(pdf["__pid"].iloc[0]), keys[0], keys[0]
            if keys[-1] != last:
                last, tail = keys[-1], []
            tail.append(sizes[keys == last])
        if pid is None:
            return
        table = _run_table(np.concatenate(tail), budget)
        single = first == last
        yield pd.DataFrame([{
            "pid": pid, "first_key": first, "last_key": last, "single": single,
            **_table_columns(table if single else None),
            "end_size": float(table[1][0]), "end_started": int(table[2][0])}])

    return fold


def _table_columns(table) -> dict:
    if table is None:
        return {"prefix": None, "exit_size": None, "started": None, "total": None}
    return {"prefix": list(table[0]), "exit_size": list(table[1]), "started": list(table[2]),
            "total": float(table[3])}


def _then(first: tuple, second: tuple, budget: float) -> tuple:
    """Table of two runs of one key, one after the other."""
    prefix, exit_size, started, total = [list(x) if np.ndim(x) else float(x) for x in first]
    left = [_enter(*second, size, budget) for size in exit_size]
    exit_size = [size for size, _ in left]
    started = [n + more for n, (_, more) in zip(started, left)]
    if prefix[-1] <= budget:  # all of the first may pass into the open group
        for p, size, n in zip(*second[:3]):
            prefix.append(total + p)
            exit_size.append(size)
            started.append(n)
            if prefix[-1] > budget:
                break
    return prefix, exit_size, started, total + float(second[3])


def _table(row) -> tuple:
    return row.prefix, row.exit_size, row.started, row.total


def _walk(rows, budget: float, key=None, size: float = 0.0, groups: int = 0):
    """Yields each summary with the state it continues (None if it does not); then the end."""
    for r in rows:
        continues = key is not None and r.first_key == key
        yield r, (size, groups) if continues else None
        if r.single and continues:
            size, more = _enter(*_table(r), size, budget)
            groups += more
        else:
            size, groups = r.end_size, r.end_started
        key = r.last_key
    yield None, (float(size), int(groups))


def _composed(rows: Sequence, budget: float) -> dict:
    """Summary of a run of summaries in order."""
    *_, (_, end) = _walk(rows, budget)
    key = rows[0].first_key
    single = all(r.single and r.first_key == key for r in rows)
    table = reduce(lambda a, b: _then(a, b, budget), map(_table, rows)) if single else None
    return {"first_key": key, "last_key": rows[-1].last_key, "single": single,
            **_table_columns(table), "end_size": end[0], "end_started": end[1]}


def _up(budget: float):
    def run(block: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.sort_values("pid").itertuples(index=False))
        return pd.DataFrame([{"pid": int(block[0]), **_composed(rows, budget)}])

    return run


def _down(budget: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.sort_values("pid").itertuples(index=False))
        open_size, groups = rows[0].open_size, rows[0].groups
        start = () if pd.isna(groups) else (rows[0].first_key, open_size, int(groups))
        told = [(r.pid, *state) for r, state in _walk(rows, budget, *start) if r and state]
        return pd.DataFrame(told, columns=["pid", "open_size", "groups"])

    return run


def _carried(summary: DataFrame, budget: float) -> DataFrame:
    """(pid, open_size, groups) of the partitions that continue the key before them."""
    levels = [summary]
    width = (summary.agg(F.max("pid")).first()[0] or 0) + 1
    while width > FAN:
        levels.append(materialize(levels[-1].groupBy(_block()).applyInPandas(
            _up(budget), _SUMMARY)))
        width = -(-width // FAN)
    state = summary.sparkSession.createDataFrame([], _STATE)
    for level in reversed(levels):
        told = level.withColumn("block", _block()).join(
            state.withColumnRenamed("pid", "block"), "block", "left")
        state = told.groupBy("block").applyInPandas(_down(budget), _STATE)
    return state


def _block() -> Column:
    return F.floor(F.col("pid") / FAN).cast("int").alias("block")


def _number(budget: float):
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, size, group = None, 0.0, -1
        started = False
        for pdf in batches:
            if pdf.empty:
                continue
            if not started:
                started = True
                row = pdf.iloc[0]
                if not pd.isna(row["__groups"]):
                    key, size, group = row["__key"], row["__open"], int(row["__groups"]) - 1
            out = np.empty(len(pdf), dtype=np.int64)
            for i, (k, s) in enumerate(zip(pdf["__key"].tolist(), pdf["__size"].tolist())):
                if k != key:
                    key, size, group = k, float(s), 0
                elif size + s > budget:
                    size, group = float(s), group + 1
                else:
                    size += s
                out[i] = group
            pdf = pdf.drop(columns=["__key", "__size", "__pid", "__open", "__groups"])
            pdf["group_no"] = out
            yield pdf

    return fold


def pack(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: Column,
         budget: float, keep: Sequence[str] = ()) -> DataFrame:
    """Number the groups (0-based per key) of ``keys``, ``order`` and ``keep`` columns.

    Pass narrow columns only; join the text back by id afterwards.
    """
    cols = [*keys, *order, *[c for c in keep if c not in keys and c not in order]]
    key = F.to_json(F.struct(*keys))
    narrow = df.select(*cols, key.alias("__key"), size.cast("double").alias("__size"))
    ranged = narrow.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    # Both passes must see the same partitions, so their bounds are fixed on disk.
    fixed = materialize(ranged.withColumn("__pid", F.spark_partition_id()))
    summary = materialize(fixed.select("__key", "__size", "__pid").mapInPandas(
        _summaries(budget), _SUMMARY))
    # At most one row of three numbers per partition, so it can be sent to all of them.
    carried = F.broadcast(_carried(summary, budget).toDF("__pid", "__open", "__groups"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                       for f in fixed.schema.fields if not f.name.startswith("__"))
    return fixed.join(carried, "__pid", "left").mapInPandas(_number(budget), f"{schema}, group_no long")
