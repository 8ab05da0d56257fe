"""Fill-in-the-middle: texts cut into pieces, put into output order by a secondary sort.

A text is a row of units, runs of letters A-Z or single other characters.  Two hashes of the
doc_id cut the units into prefix, middle and suffix.  The map side emits pieces of some units,
keyed by document and output position; one exchange by document with a sort by position
(``repartition`` and ``sortWithinPartitions``, the DataFrame form of
repartitionAndSortWithinPartitions) puts them into output order, and the sorted stream runs
through an incremental digest, a piece at a time.  The same stream is split at its markers and
sorted again, by place in the original, for restoration; the rows are where they belong already,
so that sort needs no second exchange.

Neither side holds an output text: a task holds one row's text when it cuts it, and one piece
afterwards.  A digest is sequential, so one document is one task's work, whatever its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 1
PLAIN_FROM = 90  # of 100 documents, those from here on stay plain
SPM_BELOW = 20  # of 100 rearranged documents, those below put the suffix first
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = {"plain": (), "psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
PLACE = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}  # of a part in the original
UNITS = 2048  # units of a piece
CHARS = 1 << 14  # characters of a piece, where units are long
FLUSH = 1 << 21  # characters of a batch

_HEAD = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()),
         ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
PIECES = pa.schema([("row", pa.int64()), ("pos", pa.int64()), *_HEAD, ("text", pa.string())])
RESORTED = pa.schema([("row", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), *_HEAD,
                      ("output_sha256", pa.string()), ("text", pa.string())])
DIGESTS = pa.schema([*_HEAD, ("output_sha256", pa.string()), ("restored_sha256", pa.string())])
TEXTS = pa.schema([*_HEAD, ("text", pa.string())])


def unit_starts(text: str) -> np.ndarray:
    """Where the units of a text start, in code points."""
    folded = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) | 32
    letter = (folded >= 97) & (folded <= 122)
    starts = ~letter
    starts[:1] = True
    starts[1:] |= ~letter[:-1]
    return np.flatnonzero(starts)


def hashes(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four unsigned 32-bit numbers of a doc_id; a null id hashes as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]


def plan(doc_id: int | None, text: str, seed: int = SEED) -> tuple[int, str, int, int, np.ndarray]:
    """(units, form, where the prefix ends, where the middle ends, starts of the units)."""
    starts = unit_starts(text)
    n = len(starts)
    h1, h2, h3, h4 = hashes(doc_id, seed)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    at = [int(starts[i]) if i < n else len(text) for i in (low, high)]
    if not text or h3 % 100 >= PLAIN_FROM or any(m in text for m in PLACE):
        form = "plain"
    else:
        form = "spm" if h4 % 100 < SPM_BELOW else "psm"
    return n, form, *at, starts


def pieces_of(doc_id: int | None, text: str, seed: int = SEED) -> Iterator[tuple]:
    """Rows (pos, doc_id, n, form, prefix_chars, middle_chars, text); the first has the head."""
    n, form, first, second, starts = plan(doc_id, text, seed)
    plain = form == "plain"
    head = (doc_id, n, form, None if plain else first, None if plain else second - first)
    spans = {PREFIX: (0, first), MIDDLE: (first, second), SUFFIX: (second, len(text))}
    inner = np.union1d(starts[::UNITS], np.arange(0, len(text), CHARS))
    pos = 0
    for mark in MARKS[form] or ("",):
        low, high = spans.get(mark, (0, len(text)))
        cuts = inner[np.searchsorted(inner, low, "right"):np.searchsorted(inner, high)].tolist()
        for a, b in zip([low, *cuts], [*cuts, high]):
            yield pos, *head, mark + text[a:b]
            pos, mark, head = pos + 1, "", (None,) * 5


class _Batches:
    """Collects rows into record batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple) -> bool:
        """Take a row; true once the batch is to be taken."""
        self.rows.append(row)
        self.size += len(row[-1] or "") + 64
        return self.size > FLUSH

    def take(self) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else [[]] * len(self.schema)
        out = pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
        self.rows, self.size = [], 0
        return out


def _batched(schema: pa.Schema, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held = _Batches(schema)
    for row in rows:
        if held.add(row):
            yield held.take()
    if held.rows:
        yield held.take()


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


class Splitter:
    """Cuts an output, fed a piece at a time, into (place in the original, text).

    A marker lies within one piece.  The original holds no marker and no marker can overlap
    another, so the first occurrence of each is the one that was put in.
    """

    def __init__(self, form: str):
        self.marks, self.place = list(MARKS[form]), 0

    def feed(self, text: str) -> Iterator[tuple[int, str]]:
        while self.marks and (at := text.find(self.marks[0])) >= 0:
            if at:
                yield self.place, text[:at]
            self.place = PLACE[self.marks.pop(0)]
            text = text[at + 3:]
        if text:
            yield self.place, text


def restore(text: str, form: str) -> str:
    """The original of one output text."""
    return "".join(t for _, t in sorted(Splitter(form).feed(text), key=lambda x: x[0]))


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def pieces(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(row, pos, head columns, text): the pieces of every output text, in output order.

    Each row of ``docs`` has a number of its own, so repeated rows and null ids do not mix; the
    number is that of the row's place in its input split, hence ``docs`` should be a table.  A
    row's pieces lie in one partition, sorted by pos; a text without characters has one piece.
    Only doc_id and text are read; a null text is an empty one.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(PIECES, (
            (row, *piece) for row, doc_id, text in _each(batches)
            for piece in pieces_of(doc_id, text or "", seed)))

    rows = docs.select(F.monotonically_increasing_id().alias("row"),
                       F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, _ddl(PIECES)).repartition("row").sortWithinPartitions("row", "pos")


def _output_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces -> the parts of the original, and after them the head with the digest."""
    def rows() -> Iterator[tuple]:
        held = None
        for row, pos, *head, text in _each(batches):
            if pos == 0:
                if held is not None:
                    yield (*held, digest.hexdigest(), None)
                held = (row, 9, 0, *head)
                digest, splitter, seq = hashlib.sha256(), Splitter(head[2]), 0
            digest.update(text.encode())
            for place, part in splitter.feed(text):
                yield row, place, seq, *(None,) * 6, part
                seq += 1
        if held is not None:
            yield (*held, digest.hexdigest(), None)

    yield from _batched(RESORTED, rows())


def _restored_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts in the order of the original, each document's head last -> its two digests."""
    def rows() -> Iterator[tuple]:
        digest = hashlib.sha256()
        for _, part, _, *head, output, text in _each(batches):
            if part == 9:
                yield *head, output, digest.hexdigest()
                digest = hashlib.sha256()
            else:
                digest.update(text.encode())

    yield from _batched(DIGESTS, rows())


def digests(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row.

    A null or empty text is plain, with no units.  Repeated rows each give a row; a null doc_id
    hashes as an empty one.  An empty table gives an empty result.
    """
    return pieces(docs, seed).mapInArrow(_output_digests, _ddl(RESORTED)).sortWithinPartitions(
        "row", "part", "seq").mapInArrow(_restored_digests, _ddl(DIGESTS))


def fill_in_middle(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, text): every row's output text, whole."""
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held, parts = None, []
            for _, pos, *head, text in _each(batches):
                if pos == 0:
                    if held is not None:
                        yield *held, "".join(parts)
                    held, parts = head, []
                parts.append(text)
            if held is not None:
                yield *held, "".join(parts)

        yield from _batched(TEXTS, rows())

    return pieces(docs, seed).mapInArrow(join, _ddl(TEXTS))
