"""Whitening of embeddings with an exact covariance from bit planes.

Entries become integers.  Over the distinct vectors, each dimension less its least value is
written as bit planes: plane a of dimension i packs bit a of every row into 64-bit words.  The
sum of products of two dimensions is the sum over pairs of planes of 2^(a+b) times the number of
bits set in both, so word-wise AND and a bit count give exact cross-products.  Partial sums of a
task are one row for each pair of dimensions, added up in Spark as decimals; the driver gets
as many numbers as a covariance matrix has, whatever the number of vectors.  They are centred as
integers before they become floating point.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
LARGEST = float(1 << 52)  # scaled entries beyond this, either sign, are kept at it
BLOCK = 8192  # rows packed into planes at a time
EXACT = 1 << 62  # integers below this are handled as 64-bit ones


def integer_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, x): the integer form of every vector that is usable, null entries being none.

    Vectors that are null, empty, or hold null or non-finite entries are dropped.
    """
    c = F.col(column).cast("array<double>")
    usable = F.coalesce(F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (
        F.abs(v) != F.lit(float("inf")))), F.lit(False)) & (F.size(c) > 0)
    scaled = F.transform(c, lambda v: F.floor(F.least(F.greatest(
        v * SCALE, F.lit(-LARGEST)), F.lit(LARGEST))) + SHIFT)
    return vectors.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"),
                                         scaled.cast("array<long>").alias("x"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def bit_planes(y: np.ndarray, bits: list[int]) -> np.ndarray:
    """Planes of the non-negative columns of ``y``, one row of words for each bit in order."""
    rows = -(-len(y) // 64) * 64
    padded = np.zeros((rows, y.shape[1]), np.uint64)
    padded[:len(y)] = y.view(np.uint64)
    out = np.empty((sum(bits), rows // 64), np.uint64)
    at = 0
    for d, size in enumerate(bits):
        for a in range(size):
            bit = (padded[:, d] >> np.uint64(a)).astype(np.uint8) & 1
            out[at] = np.packbits(bit, bitorder="little").view(np.uint64)
            at += 1
    return out


def cross_products(y: np.ndarray, bits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(sums, sums of products) over the rows of ``y``, exact, as arrays of Python integers."""
    width, planes = len(bits), bit_planes(y, bits)
    cross = np.zeros((width, width), object)
    sums = np.zeros(width, object)
    live = [d for d in range(width) if bits[d]]
    if not live:
        return sums, cross
    counts = np.zeros((len(planes), len(planes)), np.int64)
    for p in range(len(planes)):
        counts[p, p:] = np.bitwise_count(planes[p] & planes[p:]).sum(1, dtype=np.int64)
    counts += np.triu(counts, 1).T
    wide = 2 * max(bits) + len(y).bit_length() > 61
    kind = object if wide else np.int64
    weight = np.array([1 << a for d in live for a in range(bits[d])], kind)
    starts = np.cumsum([0, *(bits[d] for d in live[:-1])])
    # A plane and itself share all its bits.
    alone = np.add.reduceat(np.diag(counts).astype(kind) * weight, starts)
    both = np.add.reduceat(np.add.reduceat(
        counts.astype(kind) * weight[:, None] * weight[None, :], starts, 0), starts, 1)
    sums[live] = alone.astype(object)
    cross[np.ix_(live, live)] = both.astype(object)
    return sums, cross


@dataclass
class Whitening:
    """Exact counts and sums of the fit list, and its components, each with its eigenvalue."""

    n: int
    least: np.ndarray  # per dimension, int64
    sums: list[int]  # of x less the least value
    vectors: np.ndarray  # dimensions x components
    values: np.ndarray
    explained: np.ndarray
    degenerate: np.ndarray  # eigenvalues that are zero but for rounding

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, exact."""
        y = x - self.least
        sums = np.array(self.sums, object)
        if self.n * max(int(y.max(initial=0)), -int(y.min(initial=0))) < EXACT and \
                max(map(abs, self.sums), default=0) < EXACT:
            return y * np.int64(self.n) - sums.astype(np.int64)
        return y.astype(object) * self.n - sums

    def squared(self, dev: np.ndarray) -> list[int | None]:
        """Sums of squares; null beyond 64 bits."""
        most = max(abs(int(dev.max(initial=0))), abs(int(dev.min(initial=0))))
        if dev.dtype == np.int64 and most ** 2 * dev.shape[1] < EXACT:
            return (dev * dev).sum(1).tolist()
        totals = (dev.astype(object) ** 2).sum(1).tolist()
        return [t if t < 1 << 63 else None for t in totals]

    def whiten(self, dev: np.ndarray) -> np.ndarray:
        """Projections of (n*x - S) / n, divided by their deviation; NaN where that is zero."""
        centred = dev.astype(np.float64) / self.n
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (centred @ self.vectors) / np.sqrt(self.values)
        out[:, self.degenerate] = np.nan
        return out


def _bounds(fit: DataFrame, width: int) -> tuple[list[int], list[int], int]:
    """Least and greatest entry of each dimension and the number of vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        rows = 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), width)
                rows += len(x)
                low = x.min(0) if low is None else np.minimum(low, x.min(0))
                high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(width), pa.int32()), pa.array(low), pa.array(high),
                 pa.array([rows] * width, pa.int64())], ["dim", "low", "high", "n"])

    found = fit.mapInArrow(run, "dim int, low long, high long, n long").groupBy("dim").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect()
    found.sort()
    return [r.low for r in found], [r.high for r in found], found[0].n if found else 0


def _totals(fit: DataFrame, least: list[int], bits: list[int]) -> tuple[list[int], np.ndarray]:
    """Exact sums and sums of products over the fit list, entries less ``least``."""
    width, low = len(least), np.array(least, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, cross = np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            y = _matrix(batch.column(0), width) - low
            for at in range(0, len(y), BLOCK):
                part = cross_products(np.ascontiguousarray(y[at:at + BLOCK]), bits)
                sums, cross = sums + part[0], cross + part[1]
        i, j = np.triu_indices(width)
        values = [*sums.tolist(), *cross[i, j].tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([*range(width), *i.tolist()], pa.int32()),
             pa.array([*[-1] * width, *j.tolist()], pa.int32()),
             pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))], ["i", "j", "v"])

    added = fit.mapInArrow(run, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(
        F.sum("v").alias("v")).collect()
    sums, cross = [0] * width, np.zeros((width, width), object)
    for i, j, v in added:
        if j < 0:
            sums[i] = int(v)
        else:
            cross[i, j] = cross[j, i] = int(v)
    return sums, cross


def fit_whitening(fit: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """Whitening of the rows (x) of ``fit``, all of length ``width`` and distinct."""
    least, high, n = _bounds(fit, width)
    bits = [(h - v).bit_length() for v, h in zip(least, high)]
    sums, cross = _totals(fit, least, bits)
    s = np.array(sums, object)
    centred = cross * n - s[:, None] * s[None, :]  # n squared times the covariance
    cov = np.array([[c / (n * n) for c in row] for row in centred.tolist()], float)
    trace = sum(centred[i, i] for i in range(width)) / (n * n)
    scale = 2.0 ** -np.frexp(max(trace, 1e-300))[1]
    values, vectors = np.linalg.eigh(cov * scale)
    values, vectors = values[::-1][:components] / scale, vectors[:, ::-1][:, :components]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    degenerate = values <= width * np.finfo(float).eps * max(values[0], 0)
    return Whitening(n, np.array(least, np.int64), sums, vectors * signs, values,
                     values / trace if trace else np.zeros_like(values), degenerate)


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity.

    Components without variance have no whitened values and take no part; without any the
    error is zero.
    """
    live = np.flatnonzero(~model.degenerate)
    size, width = len(live), len(model.least)
    if not size:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size))
        for batch in batches:
            if batch.num_rows:
                w = model.whiten(model.deviations(_matrix(batch.column(0), width)))[:, live]
                total[:size] += w.T @ w
                total[size] += w.sum(0)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()),
             pa.array(total.ravel())], ["i", "j", "v"])

    total = np.zeros((size + 1, size))
    for i, j, v in fit.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(
            F.sum("v")).collect():
        total[i, j] = v
    mean = total[size] / model.n  # zero but for rounding, the rows being centred exactly
    return float(np.abs(total[:size] / model.n - np.outer(mean, mean) - np.eye(size)).max())


RESULT = ("vec_id long, component int, n long, deviation long, whitened double, "
          "explained double, identity_error double")


def whiten(vectors: DataFrame, column: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: (vec_id, component, n, deviation, whitened,
    explained, identity_error).

    Vectors that are null, empty, or hold null or non-finite entries are dropped, and so are
    those of another length than most (of lengths equally common the greatest counts).  Repeated
    rows and null ids each give rows; equal vectors count once in the fit.  whitened is null for a
    component without variance, deviation where it is beyond 64 bits.  An empty table gives an
    empty result.  Columns other than vec_id and the vector are not read.
    """
    spark = vectors.sparkSession
    ints = integer_vectors(vectors, column)
    common = ints.groupBy(F.size("x").alias("width")).count().orderBy(
        F.desc("count"), F.desc("width")).first()
    if common is None:
        return spark.createDataFrame([], RESULT)
    width = common["width"]
    ints = ints.filter(F.size("x") == width)
    fit = written(ints.select("x").distinct())
    model = fit_whitening(fit, width, components)
    error, size = identity_error(fit, model), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dev = model.deviations(_matrix(batch.column(1), width))
            rows = len(dev)
            out = model.whiten(dev).ravel()
            each = np.repeat(np.arange(rows), size)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(each)),
                 pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), rows)),
                 pa.array(np.full(rows * size, model.n)),
                 pa.array(model.squared(dev), pa.int64()).take(pa.array(each)),
                 pa.array(out, mask=np.isnan(out)),
                 pa.array(np.tile(model.explained, rows)),
                 pa.array(np.full(rows * size, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained",
                 "identity_error"])

    return ints.mapInArrow(run, RESULT)
