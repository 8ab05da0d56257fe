"""Quality rules per host: rule failures by domain, shrunk by an empirical beta prior.

Every document is measured and held against a few rules.  Failures are counted per host (here:
the source of a document) and rule; how the hosts' rates spread gives a beta prior for each rule
by the method of moments, and a host's shrunk rate is the mean of its posterior.  A host whose
shrunk rate of any rule is too high is rejected with all its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.skew import lookup_join
from foliant.session import materialize

WINDOW = 8  # words of a repeated window
MIN_WORDS = 20
REPEAT_PERCENT = 30
HOST_LIMIT = 0.5  # shrunk failure rate above which a host is rejected
SYMBOLS = frozenset("#*$%&|<>")
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
COUNTS = tuple(x.split()[0] for x in MEASURES.split(", "))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more."""
    n = len(words)
    if n <= window:
        return 0
    index: dict[bytes, int] = {}
    names = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    if len(index) == n:
        return 0
    # Windows get equal numbers where they are equal: pairs of numbers name twice the width.
    width = 1
    while width < window:
        step = min(width, window - width)
        _, names = np.unique(names[:len(names) - step] * n + names[step:], return_inverse=True)
        width += step
    again = np.bincount(names)[names] > 1
    if not again.any():
        return 0
    covered = np.zeros(n + 1, np.int64)
    covered[:len(again)] += again
    covered[window:window + len(again)] -= again
    return int((np.cumsum(covered[:n]) > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text.

    Words are runs of anything but ASCII white space; a null text has none.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return 0, 0, 0, 0, 0
    spaces = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"))
    symbols = sum(raw.count(s.encode()) for s in SYMBOLS)
    repeats = 0
    if b"\n" in raw:
        lines = [x for x in raw.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
        repeats = len(lines) - len(set(lines))
    return len(words), len(text) - spaces, symbols, repeats, repeated_words(words)


def with_measures(docs: DataFrame) -> DataFrame:
    """(doc_id, host, MEASURES) of every row; the host is the source, of a null one a host too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([measure(t.as_py()) for t in batch.column(2)], np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 *(pa.array(np.ascontiguousarray(found[:, i])) for i in range(5))],
                ["doc_id", "host", *COUNTS])

    host = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.alias("host"),
                       F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id long, host string, {MEASURES}")


def base_failure() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Name and failure of each rule that hosts are judged by."""
    words = F.col("n_words")
    return {
        "base": base_failure(),
        "symbols": 10 * F.col("n_symbols") > words,
        "lines": 5 * F.col("n_dup_lines") > words,
        "lengths": (F.col("word_chars") > 12 * words) | (F.col("word_chars") < 2 * words),
    }


def host_rates(measured: DataFrame) -> DataFrame:
    """One row per host: documents, and for each rule its failures and shrunk rate.

    With mean m and variance v of the hosts' rates (hosts weigh alike), and n the harmonic mean
    of their sizes, the spread beyond binomial noise is v - m(1-m)/n; it gives the prior's
    strength m(1-m)/spread - 1.  Hosts that do not differ beyond noise are pooled (strength
    1e6); the strength is at least 1, so a small host never stands on its own documents alone.
    """
    named = rules()
    hosts = measured.groupBy("host").agg(F.count("*").alias("docs"), *[
        F.sum(F.coalesce(fails.cast("long"), F.lit(0))).alias(f"failed_{rule}")
        for rule, fails in named.items()])
    rate = {rule: F.col(f"failed_{rule}") / F.col("docs") for rule in named}
    spread = hosts.agg(
        (F.count("*") / F.sum(1 / F.col("docs"))).alias("size"),
        *[F.avg(rate[r]).alias(f"mean_{r}") for r in named],
        *[F.var_pop(rate[r]).alias(f"var_{r}") for r in named])
    both = hosts.crossJoin(F.broadcast(spread))  # one row
    for r in named:
        mean, var = F.col(f"mean_{r}"), F.col(f"var_{r}")
        noise = mean * (1 - mean)
        beyond = var - noise / F.col("size")
        strength = F.when(beyond <= 0, F.lit(1e6)).otherwise(
            F.greatest(F.lit(1.0), F.least(F.lit(1e6), noise / beyond - 1)))
        both = both.withColumn(f"rate_{r}", (F.col(f"failed_{r}") + mean * strength) / (
            F.col("docs") + strength))
    return both.select("host", "docs", *[f"failed_{r}" for r in named],
                       *[f"rate_{r}" for r in named])


def judge(docs: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """doc_id, the measures, base_failed and kept of every row of ``docs``.

    kept is false for a base failure and for every document of a host with a shrunk rate above
    ``limit``.  A null source is a host of its own; null and blank texts have no words and fail;
    repeated rows each count; an empty table gives an empty result.  Columns other than doc_id,
    text and source are not read.
    """
    measured = materialize(with_measures(docs))
    rates = host_rates(measured)
    verdicts = rates.select("host", F.greatest(*[
        c for c in rates.columns if c.startswith("rate_")]).alias("worst"))
    joined = lookup_join(measured, verdicts, ["host"], F.xxhash64("doc_id", *COUNTS), "left")
    return joined.select(
        "doc_id", *COUNTS, base_failure().alias("base_failed"),
        (~base_failure() & (F.coalesce("worst", F.lit(0.0)) <= limit)).alias("kept"))
