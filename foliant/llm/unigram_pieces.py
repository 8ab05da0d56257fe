"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The pieces and their log scores are read from a public ``.model`` file.  A text is marked (a
marker in front, every space a marker), cut where no piece can span, and each distinct segment is
segmented once: the trie proposes the pieces that start at each character, and the path of the
highest summed score wins.  A character that no piece covers becomes its UTF-8 bytes.  Decoding
joins pieces and bytes and turns markers into spaces.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, USER, BYTE = 1, 4, 6  # piece types of the file format
UNKNOWN_PENALTY = 10.0
SLICE = 1 << 22  # characters of text that are encoded at a time
CACHE = 400_000  # segments whose pieces a task remembers
SHORT = 48  # longer segments are walked one by one
ROWS = 20_000  # segments in one matrix
WINDOW = 256  # cells of the trie looked at together


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message in protocol-buffer wire format."""
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        if tag & 7 == 0:
            value, at = _varint(raw, at)
        else:
            size, at = {1: (8, at), 5: (4, at)}.get(tag & 7) or _varint(raw, at)
            value, at = raw[at:at + size], at + size
        yield tag >> 3, value


def read_model(path: str = MODEL) -> list[tuple[str, float, int]]:
    """(piece, score, type) in id order."""
    with open(path, "rb") as f:
        raw = f.read()
    pieces = []
    for number, value in _fields(raw):
        if number == 1:
            own = dict(_fields(value))
            pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, b"\0" * 4))[0],
                           own.get(3, NORMAL)))
    return pieces


@dataclass
class Trie:
    """Double array: the child of state s by code c is base[s] + c if check of it is s."""

    codes: dict[str, int]
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray  # piece id that ends in a state, -1 if none


def build_trie(entries: Iterable[tuple[str, int]]) -> Trie:
    tree: dict = {}
    counts: dict[str, int] = {}
    for piece, number in entries:
        node = tree
        for c in piece:
            counts[c] = counts.get(c, 0) + 1
            node = node.setdefault(c, {})
        node[""] = number
    codes = {c: i + 1 for i, c in enumerate(sorted(counts, key=lambda c: (-counts[c], c)))}
    width = len(codes) + 1
    size = width * 2
    base, check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
    value = np.full(size, -1, np.int32)
    check[0] = 0  # the root's own cell
    todo, found = [(0, tree)], {True: 1, False: 1}  # where a lone or several cells were found last
    for state, node in todo:
        value[state] = node.get("", -1)
        kids = sorted((codes[c], c) for c in node if c)
        if not kids:
            continue
        offsets = np.array([k for k, _ in kids])
        at = found[len(kids) == 1]
        while True:
            while at + WINDOW + 2 * width >= len(check):
                more = len(check)
                base = np.concatenate([base, np.zeros(more, np.int32)])
                check = np.concatenate([check, np.full(more, -1, np.int32)])
                value = np.concatenate([value, np.full(more, -1, np.int32)])
            starts = np.flatnonzero(check[at:at + WINDOW] < 0) + at - offsets[0]
            starts = starts[starts >= 1]
            fits = (check[starts[:, None] + offsets] < 0).all(1)
            if fits.any():
                start = int(starts[fits.argmax()])
                break
            at += WINDOW
        base[state] = start
        check[start + offsets] = state
        found[len(kids) == 1] = at
        todo += [(start + k, node[c]) for k, c in kids]
    pad = np.full(width, -1, np.int32)
    return Trie(codes, base, np.concatenate([check, pad]), np.concatenate([value, pad]))


class Pieces:
    """Encoder and decoder of one model; picklable, and small (the model's size)."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        plain = [(p, i) for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER) and p]
        self.trie = build_trie(plain)
        self.code_of = np.zeros(max(map(ord, self.trie.codes), default=0) + 2, np.int32)
        for c, code in self.trie.codes.items():
            self.code_of[ord(c)] = code
        self.scores = np.array([s for _, s, _ in pieces])
        self.unknown = min((pieces[i][1] for _, i in plain), default=0.0) - UNKNOWN_PENALTY
        self.byte_ids = np.zeros(256, np.int32)
        self.raw = [p.replace(MARK, " ").encode() for p, _, _ in pieces]
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                code = int(p[1:-1], 16)
                self.byte_ids[code] = i
                self.raw[i] = bytes([code])
            elif kind not in (NORMAL, USER):
                self.raw[i] = b""  # control pieces have no text
        # No piece spans an inner marker or a character outside the alphabet.
        inner = any(MARK in p.lstrip(MARK) for p, _ in plain)
        apart = "" if "\n" in self.trie.codes else "\n"
        self.cut = re.compile(".+" if inner else f"{MARK}*[^{MARK}{apart}]+|{MARK}+|[{apart}]"
                              if apart else f"{MARK}*[^{MARK}]+|{MARK}+", re.DOTALL)
        self.known: dict[str, bytes] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def segments(self, text: str) -> list[str]:
        return self.cut.findall(MARK + text.replace(" ", MARK)) if text else []

    def _path(self, segment: str) -> list[int]:
        """Best pieces of one segment of any length; -1 for a character without one."""
        t = self.trie
        base, check, value = t.base, t.check, t.value
        codes = [t.codes.get(c, 0) for c in segment]
        n = len(codes)
        best, back = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
        for at in range(n):
            state, end, single = 0, at, False
            while end < n and codes[end]:
                onward = int(base[state]) + codes[end]
                if check[onward] != state or onward == 0:
                    break
                state, end = onward, end + 1
                piece = int(value[state])
                if piece >= 0:
                    single |= end == at + 1
                    score = best[at] + float(self.scores[piece])
                    if score > best[end]:
                        best[end], back[end] = score, (at, piece)
            if not single and best[at] + self.unknown > best[at + 1]:
                best[at + 1], back[at + 1] = best[at] + self.unknown, (at, -1)
        out = []
        while n:
            n, piece = back[n]
            out.append(piece)
        return out[::-1]

    def _paths(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """_path of many segments, character by character for all at once: (pieces, ends).

        The segments are sorted by length, so those that reach a character are a tail.
        """
        t = self.trie
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        width = int(sizes[-1])
        points = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        codes = np.zeros((len(segments), width), np.int32)
        codes[np.arange(width) < sizes[:, None]] = self.code_of[np.minimum(
            points, len(self.code_of) - 1)]
        best = np.full((len(segments), width + 1), -np.inf)
        best[:, 0] = 0
        piece = np.full((len(segments), width + 1), -1, np.int32)
        step = np.zeros((len(segments), width + 1), np.int32)
        for at in range(width):
            rows = np.arange(np.searchsorted(sizes, at, "right"), len(segments))
            state = np.zeros(len(rows), np.int64)
            lone = rows
            for end in range(at, width):
                code = codes[rows, end]
                onward = t.base[state] + code
                ok = (code > 0) & (t.check[onward] == state)
                rows, state = rows[ok], onward[ok]
                if not len(rows):
                    break
                found = t.value[state]
                ends = found >= 0
                hit, found = rows[ends], found[ends]
                if end == at:
                    lone = np.setdiff1d(lone, hit, assume_unique=True)
                score = best[hit, at] + self.scores[found]
                better = score > best[hit, end + 1]
                hit, found = hit[better], found[better]
                best[hit, end + 1] = score[better]
                piece[hit, end + 1] = found
                step[hit, end + 1] = end + 1 - at
            score = best[lone, at] + self.unknown
            better = score > best[lone, at + 1]
            hit = lone[better]
            best[hit, at + 1], piece[hit, at + 1], step[hit, at + 1] = score[better], -1, 1
        place, rows, back = sizes.copy(), np.arange(len(segments)), []
        counts = np.zeros(len(segments), np.int64)
        while len(rows):
            back.append((rows, piece[rows, place[rows]]))
            counts[rows] += 1
            place[rows] -= step[rows, place[rows]]
            rows = rows[place[rows] > 0]
        ends = np.cumsum(counts)
        flat = np.empty(int(ends[-1]), np.int32)
        for k, (rows, found) in enumerate(back):
            flat[ends[rows] - 1 - k] = found
        return flat, ends

    def _with_bytes(self, segment: str, path: list[int]) -> bytes:
        """Ids of a path, the characters without a piece as their bytes."""
        out, at = [], 0
        for p in path:
            if p >= 0:
                out.append(p)
                at += len(self.raw[p].decode())
            else:
                out += self.byte_ids[list(segment[at].encode())].tolist()
                at += 1
        return np.array(out, np.int32).tobytes()

    def _learn(self, fresh: set[str]) -> None:
        short = sorted((s for s in fresh if len(s) <= SHORT), key=len)
        for i in range(0, len(short), ROWS):
            part = short[i:i + ROWS]
            flat, ends = self._paths(part)
            raw, stops = flat.tobytes(), ends.tolist()
            for segment, start, stop in zip(part, [0, *stops], stops):
                self.known[segment] = raw[4 * start:4 * stop]
            for at in np.unique(np.searchsorted(ends, np.flatnonzero(flat < 0), "right")):
                start = stops[at - 1] if at else 0
                self.known[part[at]] = self._with_bytes(part[at], flat[start:ends[at]].tolist())
        for segment in fresh:
            if len(segment) > SHORT:
                self.known[segment] = self._with_bytes(segment, self._path(segment))

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        cut = [self.segments(t) for t in texts]
        if len(self.known) > CACHE:
            self.known = {}
        self._learn(set().union(*cut) - self.known.keys())
        known = self.known
        return [np.frombuffer(b"".join([known[s] for s in segments]), np.int32)
                for segments in cut]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text or ""])[0].tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids; bytes that are no UTF-8 become replacement characters."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def load(path: str = MODEL) -> Pieces:
    """Read a model on the driver; tasks get it with the function they run."""
    return Pieces(read_model(path))


def _slices(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size > SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_documents(docs: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """(doc_id, ids, n_ids, round_trip) of every row of ``docs`` (doc_id, text, ...).

    ``round_trip`` tells whether decoding the ids gives the text; only a text that holds the
    marker character itself (it decodes to a space) can fail.  A null or empty text has no ids.
    Repeated rows each give a row, an empty table an empty result.  Only doc_id and text are
    read.
    """
    pieces = pieces or load()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            for part in _slices(texts):
                ids = pieces.encode_batch(part)
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                same = [pieces.decode(i.tolist()) == t for i, t in zip(ids, part)]
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)),
                     pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids))),
                     pa.array(sizes.astype(np.int32)), pa.array(same)],
                    ["doc_id", "ids", "n_ids", "round_trip"])
                at += len(part)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>, n_ids int, round_trip boolean")
