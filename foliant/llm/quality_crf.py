"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad.  A line's own measures and its neighbours' are the features of its
state, and a 2 x 2 table scores the transition from line to line.  Documents labelled good train
all their lines as good, and bad ones as bad.  A document's quality is the mean of the
forward-backward marginals of *good*, weighted by line length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

FOLDS, HELD_OUT = 5, 0
TRAIN_DOCS = 4000  # labelled documents that are fitted, the first by a hash of their id
TRAIN_LINES = 2000  # longer documents do not train (they are scored like any other)
THRESHOLD = 0.3
BLOCK = 1 << 20  # characters measured at a time

UPPER, LOWER, DIGIT, SPACE, SYMBOL, STOP, OTHER = range(7)
SYMBOLS = "#*$%&|<>!@^~=+_{}[]\\"
MEASURES = 12
NEIGHBOURS = (0, 1, 3, 4, 9, 10)  # measures taken from the lines before and after
FEATURES = 1 + MEASURES + 2 * len(NEIGHBOURS)


@cache
def _classes() -> np.ndarray:
    """Character class of every code point of the basic plane; the rest is OTHER."""
    table = np.full(0x10001, OTHER, np.uint8)
    for code in range(0x10000):
        c = chr(code)
        if c.isupper():
            table[code] = UPPER
        elif c.isalpha():
            table[code] = LOWER
        elif c.isdigit():
            table[code] = DIGIT
        elif c.isspace():
            table[code] = SPACE
        elif c in SYMBOLS:
            table[code] = SYMBOL
        elif c in ".?,;:":
            table[code] = STOP
    return table


def _line_blocks(text: str) -> Iterator[list[str]]:
    """Lines with a word, in lists of bounded total length."""
    block, size = [], 0
    for line in text.split("\n"):
        if not line.isspace() and line:
            block.append(line)
            size += len(line)
            if size > BLOCK:
                yield block
                block, size = [], 0
    if block:
        yield block


def _measure(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(line lengths, measures), one row a line."""
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _classes()[np.minimum(codes, 0x10000)]
    starts = np.concatenate([[0], np.cumsum(length)[:-1]])
    share = [np.add.reduceat(kinds == k, starts, dtype=np.int64)
             for k in (UPPER, LOWER, DIGIT, SYMBOL, STOP, OTHER)]
    upper, lower, digit, symbol, stop, other = share
    words, distinct, same, pairs, ends = [], [], [], [], []
    for line in lines:
        tokens = line.split()
        words.append(len(tokens))
        distinct.append(len(set(tokens)))
        same.append(sum(map(eq, tokens, tokens[1:])))
        pairs.append(len(set(zip(tokens, tokens[1:]))))
        ends.append(line.rstrip()[-1:] in ".!?")
    n = np.maximum(np.array(words, float), 1)
    letters = np.maximum(upper + lower, 1)
    repeated = 1 - np.array(distinct) / n
    again = 1 - np.array(pairs) / np.maximum(n - 1, 1)
    again[n < 2] = 0
    out = np.stack([
        upper / letters,
        symbol / n.clip(1) / 2,
        (upper / letters > 0.6) & (upper > 3),
        np.array(same) / n,
        again,
        repeated,
        (symbol / n > 0.3),
        (again > 0.3) | (np.array(same) / n > 0.3),
        digit / length + other / length,
        np.minimum(n, 30) / 30,
        letters / n / 10,
        np.array(ends),
    ], axis=1).astype(float)
    out[:, 1] = np.minimum(out[:, 1], 3)
    return length, np.minimum(out, 5)


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, features) of the lines with a word; a text without any counts as one blank line."""
    parts = [_measure(block) for block in _line_blocks(text or "")]
    if not parts:
        blank = np.zeros((1, FEATURES))
        blank[0, 0] = 1
        return np.ones(1), blank
    length = np.concatenate([p[0] for p in parts]).astype(float)
    own = np.concatenate([p[1] for p in parts])
    near = own[:, list(NEIGHBOURS)]
    before, after = np.zeros_like(near), np.zeros_like(near)
    before[1:], after[:-1] = near[:-1], near[1:]
    return length, np.concatenate([np.ones((len(own), 1)), own, before, after], axis=1)


@dataclass(frozen=True)
class LineModel:
    """Weights of *good* against *bad* per feature, and transition scores [from][to]."""

    weights: np.ndarray
    moves: tuple[tuple[float, float], tuple[float, float]]

    def marginals(self, odds: list[float]) -> list[float]:
        """P(good) of each line, from the lines' own log-odds, by forward-backward."""
        (bb, bg), (gb, gg) = [[math.exp(x) for x in row] for row in self.moves]

        def step(r: float, gb: float, bg: float) -> float:
            # log-odds that a neighbour with log-odds r passes on
            e = math.exp(-abs(r))
            return (math.log((gg + bg * e) / (gb + bb * e)) if r > 0
                    else math.log((gg * e + bg) / (gb * e + bb)))

        ahead, r = [], None
        for u in odds:
            r = u if r is None else u + step(r, gb, bg)
            ahead.append(r)
        out, back = [0.0] * len(odds), 0.0
        for i in range(len(odds) - 1, -1, -1):
            x = max(-500.0, min(500.0, ahead[i] + back))
            out[i] = 1 / (1 + math.exp(-x))
            back = step(odds[i] + back, bg, gb)
        return out

    def score(self, text: str | None) -> float:
        length, x = line_features(text)
        good = self.marginals((x @ self.weights).tolist())
        return float(np.dot(length, good) / length.sum())


def fit_chains(chains: list[tuple[np.ndarray, int]], rounds: int = 200, decay: float = 2e-3,
               rate: float = 0.1) -> LineModel:
    """Maximise the penalised likelihood of the state sequences; (features, label) per document."""
    chains = sorted(chains, key=lambda c: -len(c[0]))
    if not chains:
        return LineModel(np.zeros(FEATURES), ((0.0, 0.0), (0.0, 0.0)))
    x = np.concatenate([c[0] for c in chains])
    sizes = np.array([len(c[0]) for c in chains])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    y = np.repeat([float(c[1]) for c in chains], sizes)
    live = [int(np.searchsorted(-sizes, -t)) for t in range(sizes[0])]  # chains longer than t
    params, count = np.zeros(FEATURES + 4), len(chains)
    first, second = np.zeros_like(params), np.zeros_like(params)
    # Every document weighs the same, however many lines it has.
    weight = np.repeat(1 / sizes, sizes)
    moved = np.zeros((2, 2))
    for size, (_, label) in zip(sizes, chains):
        moved[label, label] += (size - 1) / size
    for turn in range(1, rounds + 1):
        w, m = params[:FEATURES], params[FEATURES:].reshape(2, 2)
        u = x @ w
        alpha = np.zeros((len(x), 2))
        beta = np.zeros((len(x), 2))
        for t in range(sizes[0]):
            at = starts[:live[t]] + t
            if t:
                alpha[at] = np.logaddexp(alpha[at - 1][:, :1] + m[0], alpha[at - 1][:, 1:] + m[1])
            alpha[at, 1] += u[at]
        for t in range(sizes[0] - 2, -1, -1):
            at = starts[:live[t + 1]] + t
            onward = beta[at + 1].copy()
            onward[:, 1] += u[at + 1]
            beta[at] = np.logaddexp(onward[:, :1] + m[:, 0], onward[:, 1:] + m[:, 1])
        both = alpha + beta
        total = np.logaddexp(both[:, 0], both[:, 1])
        good = np.exp(both[:, 1] - total)
        slope = np.zeros_like(params)
        slope[:FEATURES] = x.T @ (weight * (y - good))
        inner = np.ones(len(x), bool)
        inner[starts] = False
        at = np.flatnonzero(inner)
        edge = np.empty((2, 2))
        for i in (0, 1):
            for j in (0, 1):
                p = np.exp(alpha[at - 1, i] + m[i, j] + j * u[at] + beta[at, j] - total[at])
                edge[i, j] = (weight[at] * p).sum()
        slope[FEATURES:] = (moved - edge).ravel()
        slope = slope / count - decay * params
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope ** 2
        params = params + rate * (first / (1 - 0.9 ** turn)) / (
            np.sqrt(second / (1 - 0.999 ** turn)) + 1e-8)
    m = params[FEATURES:].reshape(2, 2)
    return LineModel(params[:FEATURES], tuple(tuple(map(float, row)) for row in m))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string")) % folds


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS,
        train_lines: int = TRAIN_LINES) -> LineModel:
    """Fit on at most ``train_docs`` labelled documents outside the held-out fold.

    The sample is the first labelled ids by a hash, so it is the same at every run; a document
    of more than ``train_lines`` lines with a word does not train.  Labels other than 0 and 1,
    null ids and null labels are passed over; an id labelled twice counts by its lower label.
    """
    chosen = (labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y"))
              .filter(F.col("y").isin(0, 1) & (fold(F.col("id"), FOLDS) != HELD_OUT))
              .groupBy("id").agg(F.min("y").alias("y"))
              .orderBy(F.xxhash64("id"), "id").limit(train_docs))
    picked = docs.select("doc_id", "text").join(
        F.broadcast(chosen), F.col("doc_id") == F.col("id"))  # at most train_docs narrow rows
    picked = picked.groupBy("id").agg(F.min("y").alias("y"), F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ys, xs = [], [], []
            for id_, y, text in zip(*(c.to_pylist() for c in batch.columns)):
                x = line_features(text)[1]
                if len(x) <= train_lines:
                    ids.append(id_)
                    ys.append(y)
                    xs.append(x.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), pa.array(xs, pa.binary())],
                ["id", "y", "x"])

    rows = sorted(picked.mapInArrow(run, "id long, y int, x binary").collect())
    return fit_chains([(np.frombuffer(bytes(r.x), np.float32).reshape(-1, FEATURES).astype(float),
                        r.y) for r in rows])


def with_score(df: DataFrame, model: LineModel) -> DataFrame:
    """All columns of ``df`` (text, ...) and __score, from the whole text of each row."""
    place = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch.column(place)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "__score"])

    return df.mapInArrow(run, StructType([*df.schema, StructField("__score", DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, model: LineModel | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    A null or blank text is scored as one blank line.  Repeated rows each give a row; a null
    doc_id is not held out.  An empty table gives an empty result, and without any usable label
    every score is 0.5.  Only doc_id and text are read, of ``labels`` doc_id and quality.
    """
    model = model or fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return with_score(rows, model).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias(
            "held_out"), F.col("__score").alias("score"),
        (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier does not reject."""
    return with_score(docs, fit(docs, labels)).filter(F.col("__score") >= THRESHOLD).drop(
        "__score")
