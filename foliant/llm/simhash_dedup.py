"""SimHash near-duplicates: fingerprints of whole texts, pigeonhole blocks, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.components import components
from foliant.llm.hamming import hamming_links
from foliant.session import materialize

SEED = 42
WORDS = 4  # words of a shingle
DISTANCE = 4
PIECE = 1 << 20  # bytes of text that are split into words at a time


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded size; only ASCII white space separates."""
    at = 0
    while at < len(raw):
        end = at + PIECE
        while end < len(raw) and raw[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield raw[at:end].split()
        at = end


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash of a text's word shingles; zero without a word."""
    votes = np.zeros(64, np.int64)
    total, tail = 0, []
    digest = xxhash.xxh64_intdigest
    for piece in _pieces((text or "").encode("utf-8", "surrogatepass").lower()):
        tokens = tail + piece
        if len(tokens) >= words:
            line = b" ".join(tokens)
            ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
            starts = np.concatenate([[0], ends[:-1]])[:len(tokens) - words + 1].tolist()
            stops = (ends[words - 1:] - 1).tolist()
            hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops)], "<u8")
            votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1,
                                   bitorder="little").sum(0, dtype=np.int64)
            total += len(hashes)
            tail = tokens[len(tokens) - words + 1:]
        else:
            tail = tokens
    if not total:
        return digest(b" ".join(tail), SEED) if tail else 0
    bits = np.packbits(votes * 2 > total, bitorder="little")
    return int(bits.view("<u8")[0])


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def with_fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _signed(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, fp long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, words: int = WORDS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs`` (doc_id, text, ...).

    Words are runs of anything but ASCII white space, A-Z in lower case.  Documents link when
    their fingerprints differ in ``distance`` bits or fewer; component_id is the smallest doc_id
    reachable.  A null text is an empty one and empty texts share fingerprint zero.  Repeated
    rows each give a row.  A null doc_id takes part, but names no component: component_id is the
    smallest id that is not null, null if there is none.  An empty table gives an empty result.
    Columns other than doc_id and text are not read.
    """
    marked = materialize(with_fingerprints(docs, words))
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    links = hamming_links(distinct.select("fp"), distance, distinct.count())
    labels = components(links).select(F.col("node").alias("fp"), "label")
    rooted = distinct.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    named = rooted.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = rooted.select("fp", "label").join(named, "label").select("fp", "component_id")
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, distance: int = DISTANCE, words: int = WORDS) -> DataFrame:
    """The documents without near-duplicates: of each component the row of the smallest doc_id.

    All columns stay.  Of repeated rows of one doc_id one stays.  A row without a doc_id cannot
    be named as a copy and stays.
    """
    found = near_duplicates(docs, distance, words)
    kept = materialize(found.filter("doc_id = component_id").groupBy(
        F.col("doc_id").alias("__kept")).agg(F.count("*").alias("__rows")))
    named = docs.join(kept, F.col("doc_id") == F.col("__kept"))
    once = named.filter("__rows = 1").drop("__kept", "__rows")
    if not kept.filter("__rows > 1").isEmpty():
        once = once.unionByName(named.filter("__rows > 1").drop("__kept", "__rows")
                                .dropDuplicates(["doc_id"]))
    return once.unionByName(docs.filter("doc_id is null"))
