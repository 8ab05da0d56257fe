"""Language identification with a string kernel, Nystroem landmarks and kernel ridge regression.

Two texts are as alike as the n-grams (1 to 4 characters) that occur in both, each counted once:
k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|), the blended-spectrum presence kernel over lower-case
letters of all scripts.  A bounded sample of labelled texts gives landmarks L and a training set; with
K_LL^-1/2 the Nystroem map of a text is k(x, L) K_LL^-1/2, and a ridge regression per language
(one versus the rest) is fitted on it.  Since k(x, L) is the presence vector of x times the
landmarks' presence vectors, a batch is scored as one matrix product of its presence vectors
with a precomputed matrix of n-grams by languages.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import materialize

FOLDS, HELD_OUT = 4, 2
ORDERS = (1, 2, 3, 4)
PER_LANGUAGE = 150  # texts that train, for each language, the first by a hash of their id
LANDMARKS = 60  # of them, for each language
RIDGE = 1e-2
UNKNOWN = "und"
BATCH = 64  # texts scored together
SLICE = 1 << 18  # characters whose n-grams are held at once
SPACE = 0  # code of white space and signs; a letter's code is its code point
FACTOR = np.uint64(0x9E3779B97F4A7C15)  # odd, for the hash of an n-gram


@functools.lru_cache(1)
def letter_codes() -> np.ndarray:
    """Code by code point: letters of all scripts have their own, all else is a space."""
    points = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    return np.where([chr(c).isalpha() for c in range(sys.maxunicode + 1)], points, SPACE).astype(
        np.uint32)


def grams(text: str) -> np.ndarray:
    """Sorted distinct 64-bit n-gram hashes of a text; runs of non-letters are one space.

    The hash is a polynomial in the codes plus one, so n-grams of all scripts and orders share one
    range.  A long text is taken in slices that overlap by the longest order less one.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.concatenate([[SPACE], letter_codes()[points], [SPACE]]).astype(np.uint32)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != SPACE) | (codes[:-1] != SPACE)
    codes = codes[keep]
    found = np.zeros(0, np.int64)
    for at in range(0, len(codes), SLICE):
        part = codes[at:at + SLICE + max(ORDERS) - 1].astype(np.uint64) + np.uint64(1)
        values, value = [], np.zeros(len(part) + 1, np.uint64)
        for n in range(1, max(ORDERS) + 1):
            if len(part) < n:
                break
            value = value[:len(part) - n + 1] * FACTOR + part[n - 1:]
            if n in ORDERS:
                values.append(value)
        found = _distinct(np.concatenate([found, *(v.view(np.int64) for v in values)]))
    return found


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    return values[first]


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    vocabulary: np.ndarray  # sorted n-gram codes of the landmarks
    matrix: np.ndarray  # n-grams by languages

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        """Regression values, texts by languages, from n-gram sets: one matrix product."""
        presence = np.zeros((len(sets), len(self.vocabulary)), np.float32)
        for i, found in enumerate(sets):
            at = np.searchsorted(self.vocabulary, found)
            at[at == len(self.vocabulary)] = 0
            presence[i, at[self.vocabulary[at] == found]] = 1
        norm = np.sqrt([max(1, len(s)) for s in sets])
        return (presence @ self.matrix) / norm[:, None]


def _kernel(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    vocabulary = np.unique(np.concatenate(right))

    def presence(sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), len(vocabulary)), np.float32)
        for i, found in enumerate(sets):
            out[i, np.searchsorted(vocabulary, np.intersect1d(found, vocabulary))] = 1
        return out

    size = lambda sets: np.sqrt([len(s) for s in sets])
    return (presence(left) @ presence(right).T) / np.outer(size(left), size(right))


def fit_sets(sets: list[np.ndarray], names: list[str],
             landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """Landmarks, their whitening and the ridge regressions from training n-gram sets."""
    languages = tuple(sorted(set(names)))
    seen: dict[str, int] = {}
    chosen = []
    for i, name in enumerate(names):
        seen[name] = seen.get(name, 0) + 1
        if seen[name] <= landmarks:
            chosen.append(i)
    if not languages:
        return LanguageModel((), np.zeros(1, np.int64), np.zeros((1, 0), np.float32))
    marks = [sets[i] for i in chosen]
    among = _kernel(marks, marks).astype(np.float64)
    values, vectors = np.linalg.eigh(among)
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])  # K_LL^-1/2 on its range
    mapped = _kernel(sets, marks).astype(np.float64) @ whiten
    wanted = (np.array(names)[:, None] == np.array(languages)).astype(float)
    # Languages weigh alike, however many texts they have.
    weight = np.array([1 / names.count(n) for n in names])[:, None]
    gram = mapped.T @ (weight * mapped) + ridge * np.eye(mapped.shape[1])
    solved = np.linalg.solve(gram, mapped.T @ (weight * wanted))
    by_mark = (whiten @ solved) / np.sqrt([len(s) for s in marks])[:, None]
    vocabulary = np.unique(np.concatenate(marks))
    matrix = np.zeros((len(vocabulary), len(languages)))
    for found, row in zip(marks, by_mark):
        matrix[np.searchsorted(vocabulary, found)] += row
    return LanguageModel(languages, vocabulary, matrix.astype(np.float32))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [grams(t.as_py()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))],
            ["id", "name", "grams"])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Fit on at most ``per_language`` texts of each language outside the held-out fold.

    They are the first by a hash of doc_id, so the sample is the same at every run.  Rows
    without an id, a language or a letter do not train.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").cast("string").alias(
        "name")).filter("id is not null and name is not null").filter(
        F.crc32(F.col("id").cast("string")) % FOLDS != HELD_OUT)
    order = Window.partitionBy("name").orderBy(F.xxhash64("id"), "id")
    chosen = ids.withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= per_language).groupBy("id").agg(F.min("name").alias("name"))
    picked = docs.select(F.col("doc_id").cast("long").alias("id"),
                         F.col("text").cast("string").alias("text")).join(
        F.broadcast(chosen), "id")  # at most per_language narrow rows a language
    picked = materialize(picked.groupBy("id").agg(
        F.min("name").alias("name"), F.min("text").alias("text")).filter(
        F.col("text").rlike(r"\p{L}")))
    rows = sorted(picked.select("id", "name", "text").mapInArrow(
        _sets, "id long, name string, grams array<long>").collect())
    return fit_sets([np.array(r.grams, np.int64) for r in rows], [r.name for r in rows])


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, from its whole text.

    score is the regression value of the predicted language, cut to 0..1.  A text that is null
    or has no letter is ``und`` with score 0, and so is every text when nothing could be learnt.
    A null doc_id is not held out.  Repeated rows each give a row, an empty table an empty
    result.  Only doc_id, text and, to learn, lang are read.
    """
    model = model or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, values = [], []
            for at in range(0, batch.num_rows, BATCH):
                texts = [t.as_py() or "" for t in batch.column(1).slice(at, BATCH)]
                sets = [grams(t) for t in texts]
                lettered = [any(map(str.isalpha, t)) for t in texts]
                if not model.languages:
                    names += [UNKNOWN] * len(texts)
                    values += [0.0] * len(texts)
                    continue
                scores = model.scores(sets)
                best = scores.argmax(1)
                names += [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
                values += [float(min(1.0, max(0.0, s[b]))) if ok else 0.0
                           for s, b, ok in zip(scores, best, lettered)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(values, pa.float64())],
                ["doc_id", "lang_pred", "score"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast(
        "string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return named.select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT,
                             F.lit(False)).alias("held_out"), "lang_pred", "score")
