"""Links between 64-bit fingerprints at a small Hamming distance, found by pigeonhole blocks.

A fingerprint is cut into ``blocks`` bit ranges.  Two fingerprints that differ in at most
``distance`` bits agree on at least ``blocks - distance`` ranges, so they meet under one of the
keys made of every such choice of ranges.  More blocks mean longer keys and smaller buckets;
the number is taken from the count of fingerprints and never changes the result.

The task that holds a bucket verifies distances and emits a spanning forest of the links found
there (fewer rows than members), so the links of a large group never become all its pairs.
Buckets that a 1/64 share of the fingerprints shows to be large are dealt over chunks, and every
pair of chunks is compared in a task of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.skew import lookup_join

BITS = 64
BUCKET = 512  # expected members of a bucket of evenly spread fingerprints
CHUNK = 2048  # members of a chunk of a large bucket
SHARE = 64  # large buckets are recognised on one fingerprint in so many
SQUARE = 1024  # members up to which a bucket is compared as one matrix


def block_count(n: int, distance: int, bucket: int = BUCKET) -> int:
    """The fewest blocks whose keys spread ``n`` even fingerprints over buckets of that size."""
    blocks = distance + 1
    while blocks < 16 and n > bucket * 2 ** (BITS * (blocks - distance) / blocks):
        blocks += 1
    return blocks


def block_masks(blocks: int, distance: int) -> list[int]:
    """The bits of each choice of ranges, as signed 64-bit numbers."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    ranges = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    masks = [sum(ranges[i] for i in chosen)
             for chosen in combinations(range(blocks), blocks - distance)]
    return [mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask for mask in masks]


def block_keys(fp: Column, blocks: int, distance: int) -> Column:
    """Array of the bucket keys of a fingerprint: the bits of each choice of ranges, tagged."""
    return F.array(*(
        F.struct(F.lit(tag).cast("smallint").alias("tag"),
                 fp.bitwiseAND(F.lit(mask)).alias("bits"))
        for tag, mask in enumerate(block_masks(blocks, distance))))


def forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (from, to) of a spanning forest of the links among the fingerprints."""
    n = len(fps)
    if n <= SQUARE:
        close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance
        if np.count_nonzero(close) == n:
            return np.empty(0, int), np.empty(0, int)
        left, right = np.nonzero(np.triu(close, 1))
        if len(left) < n:
            return left, right
    rest = np.arange(n)
    source, target, queue = [], [], []
    while len(rest):
        if queue:
            at = queue.pop()
        else:
            at, rest = rest[0], rest[1:]
        near = np.bitwise_count(fps[rest] ^ fps[at]) <= distance
        found = rest[near]
        if len(found):
            source.append(np.full(len(found), at))
            target.append(found)
            queue.extend(found.tolist())
            rest = rest[~near]
    if not source:
        return np.empty(0, int), np.empty(0, int)
    return np.concatenate(source), np.concatenate(target)


def _linked(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        held: list[np.ndarray] = []  # the bucket that may go on in the next batch
        held_key = None

        def emit(groups: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            pairs = []
            for fps in groups:
                left, right = forest(fps, distance)
                if len(left):
                    pairs.append((fps[left], fps[right]))
            if pairs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([p[i] for p in pairs]).view(np.int64))
                     for i in (0, 1)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            fps = batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64)
            change = np.zeros(len(fps) - 1, bool)
            for c in columns:
                change |= c[1:] != c[:-1]
            starts = np.concatenate([[0], np.flatnonzero(change) + 1, [len(fps)]])
            first = tuple(c[0] for c in columns)
            done = []
            if held and held_key != first:
                done.append(np.concatenate(held))
                held = []
            sizes = np.diff(starts)
            last = len(sizes) - 1
            if last > 0 and held:
                done.append(np.concatenate([*held, fps[:starts[1]]]))
                held = []
                sizes[0] = 0
            done += [fps[starts[g]:starts[g + 1]] for g in np.flatnonzero(sizes[:last] > 1)]
            yield from emit(done)
            held.append(fps[starts[last]:])
            held_key = tuple(c[-1] for c in columns)
        if held:
            yield from emit([np.concatenate(held)])

    return run


def hamming_links(fingerprints: DataFrame, distance: int, count: int) -> DataFrame:
    """(a, b) links that connect whatever fingerprints at ``distance`` or fewer bits connect.

    ``fingerprints`` has one column fp (long), distinct and not null, ``count`` its number of
    rows.  The links are a subset of all close pairs with the same connected components.
    """
    blocks = block_count(count, distance)
    keyed = fingerprints.select("fp", F.explode(block_keys(F.col("fp"), blocks, distance)).alias(
        "key")).select("fp", "key.tag", "key.bits")
    large = (keyed.filter(F.pmod(F.xxhash64("fp"), F.lit(SHARE)) == 0).groupBy("tag", "bits")
             .count().filter(F.col("count") * SHARE > CHUNK)
             .select("tag", "bits", F.ceil(F.col("count") * SHARE / CHUNK).cast("int").alias(
                 "chunks")))
    dealt = lookup_join(keyed, large, ["tag", "bits"], F.col("fp"), "left")
    chunks = F.coalesce("chunks", F.lit(1))
    mine = F.pmod(F.xxhash64("fp", F.lit("chunk")), chunks).cast("int")
    dealt = dealt.withColumn("mine", mine).withColumn(
        "other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    groups = dealt.select("tag", "bits", F.least("mine", "other").alias("low"),
                          F.greatest("mine", "other").alias("high"), "fp")
    keys = ["tag", "bits", "low", "high"]
    return groups.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        _linked(distance), "a long, b long")


def suggested_blocks(count: int, distance: int) -> tuple[int, int]:
    """Blocks used for so many fingerprints, and keys per fingerprint (for documentation)."""
    blocks = block_count(count, distance)
    return blocks, math.comb(blocks, distance)
