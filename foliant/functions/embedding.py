"""Embedding providers: anything that maps a text batch to vectors through Arrow."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

DIM = 64
WORDS = 200_000  # remembered with their cells
TEXTS = 256  # counted at once
_WORD = re.compile("[a-zà-öø-ÿ]+")


def _slot(word: str, dim: int) -> tuple[int, int]:
    digest = hashlib.md5(word.encode()).hexdigest()
    return int(digest[:7], 16) % dim, 1 if int(digest[7], 16) % 2 == 0 else -1


class _Cells(dict):
    """Cell of each word seen: its slot, and ``dim`` more if it counts down.

    Forgets all words once they are many, so that a stream of new ones does not fill the worker.
    """

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS:
            self.clear()
        at, sign = _slot(word, self.dim)
        self[word] = cell = at if sign > 0 else at + self.dim
        return cell


def _counts(texts: Iterable[str | None], cells: _Cells) -> np.ndarray:
    """A row of signed term counts for each text; all words of the texts are counted at once."""
    found = [_WORD.findall(text.lower()) if text else () for text in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    at = np.fromiter(map(cells.__getitem__, chain.from_iterable(found)), np.int64, sizes.sum())
    at += np.repeat(np.arange(len(found)) * (2 * cells.dim), sizes)
    held = np.bincount(at, minlength=len(found) * 2 * cells.dim).reshape(-1, 2, cells.dim)
    return (held[:, 0] - held[:, 1]).astype(float)


def hashed_counts(text: str, dim: int = DIM) -> np.ndarray:
    """Signed term counts folded into ``dim`` slots."""
    return _counts([text], _Cells(dim))[0]


def hashed_terms(dim: int = DIM):
    """Default provider: an untrained hashed term vector (not normalised)."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cells = _Cells(dim)
        for s in texts:
            parts = [_counts(s.iloc[at:at + TEXTS], cells).astype(np.float32)
                     for at in range(0, len(s), TEXTS)]
            yield pd.Series([row for part in parts for row in part], index=s.index, dtype=object)

    return embed


def backfill(chunks: DataFrame, provider: Callable, dim: int = DIM) -> DataFrame:
    """Fill the null vectors only; a vector of the wrong size stops the job.

    Rows that have a vector pass a null text to the provider, so one pass serves both.
    """
    missing = F.col("embedding").isNull()
    made = provider(F.when(missing, F.col("content")))
    checked = F.when(F.size("vector") == dim, F.col("vector")).otherwise(
        F.raise_error(F.lit("embedding dimension mismatch")).cast("array<float>"))
    return chunks.withColumn("vector", F.when(missing, made).otherwise(F.col("embedding"))).select(
        *[c for c in chunks.columns if c != "embedding"], checked.alias("embedding"))
