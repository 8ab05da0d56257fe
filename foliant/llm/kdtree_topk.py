"""Exact top-k inner products with a KD-tree per shard.

Vectors are dealt over shards by a hash of their id.  The task that holds a shard builds a
KD-tree with numpy: median splits on the widest dimension, and for every node the tight bounding
box of its vectors.  A box bounds the inner product with a query from above, so a query visits
nodes best bound first and stops when no box can reach its k-th score.  The k-th score found in a
query's home shard is propagated: in all other shards it is the score to beat from the start.

Components are whole numbers (floor(256 x)), so scores are exact: in floating point while no sum
can leave the whole numbers that a double holds, otherwise with Python integers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import materialize

K = 5
EVERY = 50  # rows whose id is divisible by it are queries
SHARD_ROWS = 8192
QUERY_ROWS = 4096  # queries that meet a shard in one task
LEAF = 64
EXACT = 2.0 ** 53
LONG = 2 ** 63


@dataclass
class Tree:
    """Nodes in preorder with their boxes; a leaf holds the rows start..stop of ``order``."""

    order: np.ndarray
    low: np.ndarray
    high: np.ndarray
    left: list[int]  # 0 for a leaf
    right: list[int]
    start: list[int]
    stop: list[int]


def build(vectors: np.ndarray, leaf: int = LEAF) -> Tree:
    order = np.arange(len(vectors))
    low, high, left, right, starts, stops = [], [], [], [], [], []
    todo = [(0, len(vectors), -1, False)]
    while todo:
        start, stop, parent, second = todo.pop()
        node = len(low)
        part = vectors[order[start:stop]]
        low.append(part.min(0))
        high.append(part.max(0))
        left.append(0)
        right.append(0)
        starts.append(start)
        stops.append(stop)
        if parent >= 0:
            (right if second else left)[parent] = node
        spread = high[node] - low[node]
        if stop - start > leaf and spread.max() > 0:
            middle = (stop - start) // 2
            order[start:stop] = order[start:stop][np.argpartition(
                part[:, spread.argmax()], middle)]
            todo += [(start + middle, stop, node, True), (start, start + middle, node, False)]
    return Tree(order, np.array(low), np.array(high), left, right, starts, stops)


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows; exact whatever their size (objects if need be)."""
    reach = np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * left.shape[1]
    if reach < EXACT:
        return left @ right.T
    whole = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
             for m in (left, right)]
    return whole[0] @ whole[1].T


def search(own: np.ndarray, ids: np.ndarray, vectors: np.ndarray, query_rows: np.ndarray,
           queries: np.ndarray, floors: list, k: int = K) -> Iterator[tuple[int, int, int, int]]:
    """(query row, row, vec_id, score) of the k best of a shard for each query but its own row.

    ``floors`` has for each query a score that a result must reach, or None.
    """
    tree = build(vectors)
    # max over a box of q . x: each component takes the end that suits its sign.
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    bounds = _products(up, tree.high) + _products(down, tree.low)
    for i, query in enumerate(query_rows.tolist()):
        best: list[tuple] = []  # heap of (score, -vec_id, -row), the worst first
        floor, bound = floors[i], bounds[i]
        open_ = [(-bound[0], 0)]
        while open_:
            at_most, node = heapq.heappop(open_)
            if (floor is not None and -at_most < floor) or (
                    len(best) == k and -at_most < best[0][0]):
                break
            if tree.left[node]:
                for child in (tree.left[node], tree.right[node]):
                    heapq.heappush(open_, (-bound[child], child))
                continue
            rows = tree.order[tree.start[node]:tree.stop[node]]
            scores = _products(queries[i:i + 1], vectors[rows])[0]
            least = best[0][0] if len(best) == k else floor
            if least is not None:
                good = np.flatnonzero(scores >= least)
                rows, scores = rows[good], scores[good]
            for row, vec, score in zip(own[rows].tolist(), ids[rows].tolist(), scores.tolist()):
                if row == query:
                    continue
                entry = (int(score), -vec, -row)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        for score, vec, row in best:
            yield query, -row, -vec, max(-LONG, min(LONG - 1, score))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def _whole_vectors(embeddings: DataFrame) -> DataFrame:
    """(row, vec_id, v, size): floor(256 x) of the vectors that take part, rows numbered."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # Doubles stay doubles; those too large for a fraction are whole already.
    v = F.transform(x, lambda c: F.when(F.abs(c) < 2.0 ** 44, F.floor(
        F.when(F.abs(c) < 2.0 ** 44, 256 * c).otherwise(0.0)).cast("double")).otherwise(256 * c))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull())
    rows = rows.withColumn("embedding", F.col("x")).filter(fine).select("vec_id", v.alias("v"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v",
                       F.size("v").alias("size"))


def top_k(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest scores of each query.

    Queries are the rows whose vec_id is divisible by ``every``, candidates all rows but the
    query's own; ties go to the smaller vec_id.  Vectors that are null or hold a null or
    non-finite component, and rows without a vec_id, take no part.  Rows that repeat a vec_id are
    queries and candidates each of its own, and of each other.  Vectors of different lengths have no product and do not meet.  A
    score beyond a long is cut to its ends.  An empty table gives an empty result.  Only vec_id
    and embedding are read.
    """
    vectors = materialize(_whole_vectors(embeddings))
    facts = vectors.agg(F.count("*").alias("n"), F.count(F.when(
        F.col("vec_id") % every == 0, True)).alias("queries")).first()
    shards = max(1, -(-facts.n // SHARD_ROWS))
    blocks = max(1, -(-facts.queries // QUERY_ROWS))
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("row", F.lit("block")), F.lit(blocks)).cast("int")
    stored = vectors.withColumn("shard", shard).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = vectors.filter(F.col("vec_id") % every == 0).select(
        F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("size").alias("q_size"),
        shard.alias("home"), block.alias("q_block"))

    def run(stored_part: pd.DataFrame, asked_part: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(stored_part) and len(asked_part):
            floors = [None if pd.isna(x) else int(x) for x in asked_part["floor"]]
            found = list(search(
                stored_part["row"].to_numpy(), stored_part["vec_id"].to_numpy(),
                _matrix(stored_part["v"]), asked_part["query"].to_numpy(),
                _matrix(asked_part["q"]), floors, k))
        out = pd.DataFrame(found, columns=["query", "row", "vec_id", "score"]).astype("int64")
        names = dict(zip(asked_part["query"], asked_part["query_id"]))
        return out.assign(query_id=out["query"].map(names).astype("int64"))

    def meet(asked_rows: DataFrame) -> DataFrame:
        return stored.groupBy("size", "shard", "block").cogroup(
            asked_rows.groupBy("q_size", "q_shard", "q_block")).applyInPandas(
            run, "query long, row long, vec_id long, score long, query_id long")

    home = materialize(meet(asked.withColumns(
        {"q_shard": F.col("home"), "floor": F.lit(None).cast("double")})))
    # Only whole numbers that a double holds are propagated, so that no floor is rounded up.
    kth = home.groupBy("query").agg(
        F.count("*").alias("found"), F.min("score").alias("least")).filter(
        (F.col("found") >= k) & (F.abs("least") < 2 ** 53)).select(
        "query", F.col("least").cast("double").alias("floor"))
    away = asked.join(kth, "query", "left").withColumn(
        "q_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter(
        F.col("q_shard") != F.col("home"))
    both = home.unionByName(meet(away))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
