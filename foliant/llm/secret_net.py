"""Secrets in texts: patterns, and a character convolutional network over every candidate.

Three patterns give the base findings.  Candidates are the tokens that look like no word (a digit,
or letters that keep changing case); each is read with the text around it, as windows of
characters, by a small convolutional network in numpy.  It is trained on the base findings, which
are its positive labels, and on the candidates that no pattern finds, its negative ones.  Half of
the positive windows lose their surroundings in training, so that the network learns the look of
a secret and not only the word before it.

Scores are calibrated on findings of documents that did not train, each with and without its
surroundings.  There is a threshold for each
shape of token: the greatest that still finds the stated share of the labelled secrets set aside.
Candidates that reach it and touch no base finding are added as findings of kind ``net``; base
findings always stay.

Every finding of every document trains or calibrates, by the window at its start; equal windows
train once and calibrate as often as they stand.  Windows are dealt over shards by their hash; in
each round every shard trains the common network on its own, and the weighted mean of the shards
is the next one.  Scoring reads every candidate of every whole text, a long token in several
windows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from foliant.session import written

KINDS = ("assign", "access", "hex", "net")  # of spans, in the order of ties
SHARD = 4096  # windows, about, that one task trains or scores at a time
ROUNDS = 10  # passes over all windows
BINS = 1024  # parts that a range is cut into in the search for a value by its rank
RECALL = 0.98  # share of the labelled findings set aside that a threshold must find
FEWEST = 50  # findings set aside for a threshold of one shape; else that of all shapes
FOLDS, ASIDE = 5, 0  # crc32 of the id as text, modulo; the fold that calibrates

# The patterns of the base findings.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
                    r"""([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE = 12  # characters of an assigned value
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

TOKEN = re.compile(r"[A-Za-z0-9+/_.-]{12,}={0,2}")
_DIGIT, _RISE = re.compile("[0-9]"), re.compile("[a-z][A-Z]")
SHAPES = (re.compile("[0-9]+"), re.compile("[0-9a-f]+"), re.compile("[A-Z0-9]+"))

LEFT, RIGHT, STEP = 24, 48, 32  # characters before and after a window's place, and to the next
WIDTH = LEFT + RIGHT
CODES, EMBED, FILTERS, SPAN, HIDDEN = 100, 8, 24, 5, 24


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, where the value starts) of the base findings, by start, then kind."""
    found = []
    low = text.lower()
    if any(word in low for word in WORDS):
        found += [(m.start(), m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(text)
                  if m.end() - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(*m.span(), "access", m.start()) for m in ACCESS.finditer(text)]
    found += [(*m.span(), "hex", m.start()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, base: list[tuple[int, int, str, int]]) -> list[tuple[int, int]]:
    """Tokens that look like no word and touch no base finding."""
    found, at = [], 0
    # The farthest end of the base findings that start before a place.
    ends = np.maximum.accumulate([b[1] for b in base]).tolist() if base else []
    for m in TOKEN.finditer(text):
        start, end = m.span()
        while at < len(base) and base[at][0] < end:
            at += 1
        if at and ends[at - 1] > start:
            continue
        token = m[0]
        if _DIGIT.search(token) or len(_RISE.findall(token)) >= 3:
            found.append((start, end))
    return found


def shape(token: str) -> int:
    """0 digits, 1 lower-case hex, 2 capitals and digits, 3 any other."""
    return next((i for i, s in enumerate(SHAPES) if s.fullmatch(token)), len(SHAPES))


def windows(text: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """(WIDTH characters, of the token before the place LEFT, of it from there on) for places
    that step through a token."""
    for at in range(start, max(end - RIGHT + STEP, start + 1), STEP):
        left = text[max(0, at - LEFT):at].rjust(LEFT, "\0")
        yield (left + text[at:at + RIGHT].ljust(RIGHT, "\0"), min(at - start, LEFT),
               min(end - at, RIGHT))


def encode(texts: list[str]) -> np.ndarray:
    """Codes of the characters of windows: ASCII one each, letters and others beyond one."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(points < 127, points.astype(np.int64) - 31, 98)
    codes[points < 32] = 97
    codes[points == 0] = 0
    codes[points > 0xFF] = 99
    return np.clip(codes, 0, CODES - 1).astype(np.uint8).reshape(-1, WIDTH)


def insides(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which characters of the windows belong to the token."""
    place = np.arange(WIDTH)
    return (place >= LEFT - before[:, None]) & (place < LEFT + after[:, None])


@dataclass
class Network:
    """Embedding, one convolution, pooling inside and outside the token, one hidden layer."""

    params: dict[str, np.ndarray] = field(default_factory=dict)

    # Shapes of the parameters, in order.
    SIZES = {"embed": (CODES, EMBED), "conv": ((EMBED + 1) * SPAN, FILTERS),
             "conv_b": (FILTERS,), "hid": (3 * FILTERS, HIDDEN), "hid_b": (HIDDEN,),
             "out": (HIDDEN,), "out_b": (1,)}

    @classmethod
    def fresh(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        return cls({k: np.zeros(s) if k.endswith("_b") else rng.normal(
            0, 0.3 if k == "embed" else (2 / s[0]) ** 0.5, s) for k, s in cls.SIZES.items()})

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        """The network whose parameters are views of one array, in the order of SIZES."""
        ends = np.cumsum([np.prod(s) for s in cls.SIZES.values()])[:-1]
        return cls({k: part.reshape(s) for (k, s), part in zip(
            cls.SIZES.items(), np.split(flat, ends))})

    def flat(self) -> np.ndarray:
        return np.concatenate([self.params[k].ravel() for k in self.SIZES])

    def forward(self, codes: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, dict]:
        """Log odds of the windows, and what training needs of the way there."""
        p = self.params
        x = np.zeros((len(codes), WIDTH + SPAN - 1, EMBED + 1))
        mid = slice(SPAN // 2, SPAN // 2 + WIDTH)
        x[:, mid, :EMBED] = p["embed"][codes]
        x[:, mid, EMBED] = inside
        cols = np.concatenate([x[:, i:i + WIDTH] for i in range(SPAN)], axis=2)
        h = np.maximum(cols @ p["conv"] + p["conv_b"], 0)
        best_in = np.where(inside[:, :, None], h, -1).argmax(1)
        best_out = np.where(inside[:, :, None], -1, h).argmax(1)
        pick = np.arange(len(codes))[:, None], slice(None), np.arange(FILTERS)[None, :]
        size = np.maximum(inside.sum(1), 1)[:, None]
        any_out = (~inside).any(1)[:, None]
        z = np.concatenate([
            h[pick[0], best_in, pick[2]], np.where(any_out, h[pick[0], best_out, pick[2]], 0),
            (h * inside[:, :, None]).sum(1) / size], axis=1)
        a = np.maximum(z @ p["hid"] + p["hid_b"], 0)
        return a @ p["out"] + p["out_b"][0], {
            "cols": cols, "h": h, "in": best_in, "out": best_out, "size": size, "z": z, "a": a,
            "any_out": any_out}

    def gradient(self, codes: np.ndarray, inside: np.ndarray, y: np.ndarray
                 ) -> dict[str, np.ndarray]:
        """Slopes of the mean logistic loss."""
        p = self.params
        logit, k = self.forward(codes, inside)
        d = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - y) / len(y)
        g = {"out": k["a"].T @ d, "out_b": np.array([d.sum()])}
        da = d[:, None] * p["out"] * (k["a"] > 0)
        g |= {"hid": k["z"].T @ da, "hid_b": da.sum(0)}
        dz = da @ p["hid"].T
        first, second, third = (dz[:, i * FILTERS:(i + 1) * FILTERS] for i in range(3))
        dh = (third / k["size"])[:, None, :] * inside[:, :, None]
        rows, cols = np.arange(len(y))[:, None], np.arange(FILTERS)[None, :]
        np.add.at(dh, (rows, k["in"], cols), first)
        np.add.at(dh, (rows, k["out"], cols), second * k["any_out"])
        dh *= k["h"] > 0
        flat = dh.reshape(-1, FILTERS)
        g |= {"conv": k["cols"].reshape(len(flat), -1).T @ flat, "conv_b": flat.sum(0)}
        back = (flat @ p["conv"].T).reshape(len(y), WIDTH, SPAN, EMBED + 1)[..., :EMBED]
        dx = np.zeros((len(y), WIDTH + SPAN - 1, EMBED))
        for i in range(SPAN):
            dx[:, i:i + WIDTH] += back[:, :, i]
        g["embed"] = np.zeros_like(p["embed"])
        np.add.at(g["embed"], codes.ravel(),
                  dx[:, SPAN // 2:SPAN // 2 + WIDTH].reshape(-1, EMBED))
        return g

    def logits(self, codes: np.ndarray, inside: np.ndarray, step: int = 256) -> np.ndarray:
        return np.concatenate([np.empty(0), *(
            self.forward(codes[i:i + step], inside[i:i + step])[0]
            for i in range(0, len(codes), step))])


def without_surroundings(codes: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Windows whose characters outside the token are blanks."""
    return np.where(inside, codes, 1).astype(np.uint8)


def train_round(state: np.ndarray, turn: int, codes: np.ndarray, inside: np.ndarray,
                y: np.ndarray, rng: np.random.Generator, batch: int = 64, rate: float = 4e-3
                ) -> np.ndarray:
    """One pass of Adam over shuffled batches; half of all windows are shown without surroundings.

    ``state`` has three rows, parameters and both moments, and ``turn`` batches went before.
    """
    state = state.copy()
    net, *moments = (Network.of(row) for row in state)
    order = rng.permutation(len(y))
    blank = rng.random(len(y)) < 0.5
    for at in range(0, len(y), batch):
        part = order[at:at + batch]
        shown = np.where(blank[part, None], without_surroundings(codes[part], inside[part]),
                         codes[part])
        turn += 1
        for k, g in net.gradient(shown, inside[part], y[part]).items():
            first, second = (m.params[k] for m in moments)
            first += 0.1 * (g - first)
            second += 0.001 * (g * g - second)
            net.params[k] -= rate * (first / (1 - 0.9 ** turn)) / (
                np.sqrt(second / (1 - 0.999 ** turn)) + 1e-8)
    return state


def newton(ones: int, zeros: int, sums: Callable) -> tuple[float, float]:
    """Slope (not negative) and offset that turn scores into log odds, by Newton's method.

    Targets keep off 0 and 1 by the count of each label, so that the fit stays finite.  ``sums``
    takes slope and offset of a tenth of the scores and the targets of both labels, and gives
    the sums of h x x, h x, h, d x and d for slope h and residual d of each tenth x.
    """
    targets = 1 / (zeros + 2), (ones + 1) / (ones + 2)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        hxx, hx, h, dx, d = sums(w, targets)
        step = np.clip(np.linalg.solve(
            np.array([[hxx, hx], [hx, h]]) + 1e-6 * np.eye(2), np.array([dx, d])), -2, 2)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]) / 10, 0.0), float(w[1])


def calibrate(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of scores at hand, see :func:`newton`."""
    x = logit / 10

    def sums(w: np.ndarray, targets: tuple[float, float]) -> tuple:
        p = 1 / (1 + np.exp(-np.clip(w[0] * x + w[1], -30, 30)))
        h, d = p * (1 - p) + 1e-9, np.where(y > 0, targets[1], targets[0]) - p
        return (h * x * x).sum(), (h * x).sum(), h.sum(), (d * x).sum(), d.sum()

    return newton(int(y.sum()), int((1 - y).sum()), sums)


@dataclass
class Detector:
    """A network, its calibration, and a threshold for each shape."""

    net: Network
    slope: float
    offset: float
    thresholds: list[float]

    def odds(self, logit: np.ndarray) -> np.ndarray:
        """Probabilities; they rise with the network's log odds."""
        x = self.slope * logit + self.offset
        return 1 / (1 + np.exp(-np.clip(x, -50, 50)))

    def scores(self, codes: np.ndarray, inside: np.ndarray) -> np.ndarray:
        return self.odds(self.net.logits(codes, inside))


def rank_for(count: int, recall: float = RECALL) -> int:
    """Rank from 0 upwards of the greatest value that at least ``recall`` of them reach."""
    return int(np.floor((1 - recall) * count + 1e-9))


def recall_threshold(scores: np.ndarray, recall: float = RECALL) -> float:
    """The greatest threshold that at least ``recall`` of the scores reach."""
    return float(np.sort(scores)[rank_for(len(scores), recall)])


FINDING = "aside boolean, label int, shape int, before int, after int, codes binary"


def _findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(aside, text) -> one window of each finding and of each other candidate."""
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.bool_()), *(pa.array(c, pa.int32()) for c in columns[1:5]),
             pa.array([c.tobytes() for c in encode(list(columns[5]))], pa.binary())],
            [f.split()[0] for f in FINDING.split(", ")])

    rows: list[tuple] = []
    for batch in batches:
        for aside, text in zip(*(c.to_pylist() for c in batch.columns)):
            base = base_spans(text)
            labelled = list(dict.fromkeys((1, b[3], b[1]) for b in base))
            labelled += [(0, *c) for c in candidates(text, base)]
            for label, start, end in labelled:
                window, before, after = next(windows(text, start, end))
                rows.append((aside, label, shape(text[start:end]), before, after, window))
                if len(rows) == 4096:
                    yield batch_of(rows)
                    rows = []
    if rows:
        yield batch_of(rows)


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS


def findings(docs: DataFrame) -> DataFrame:
    """(FINDING, n): the distinct windows of all findings of all rows, and how often they stand."""
    texts = docs.select((fold(F.col("doc_id").cast("long")) == ASIDE).alias("aside"), F.col(
        "text").cast("string").alias("text")).filter("text is not null")
    found = texts.mapInArrow(_findings, FINDING)
    return found.groupBy(*found.columns).agg(F.count("*").alias("n"))


def _sharded(found: DataFrame, count: int) -> GroupedData:
    """The windows dealt evenly, each always to the same shard."""
    shards = -(-count // SHARD)
    place = F.pmod(F.xxhash64("codes", "before", "after", "label", "aside"), F.lit(shards))
    # A count of partitions keeps shards apart that are small in bytes, but not in work.
    return found.withColumn("shard", place.cast("int")).repartition(shards, "shard").groupBy(
        "shard")


def _opened(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A shard in an order of its own, its codes, and which of them belong to the token."""
    table = table.sort_by([(c, "ascending") for c in (
        "codes", "before", "after", "label", "aside", "shape")])
    codes = np.frombuffer(b"".join(table["codes"].to_pylist()), np.uint8).reshape(-1, WIDTH)
    return table, codes, insides(table["before"].to_numpy(), table["after"].to_numpy())


def _exact(value: Column) -> Column:
    """The sum, the same in whatever order."""
    return F.sum(value.cast("decimal(28,16)")).cast("double")


def train(learns: DataFrame, count: int, rounds: int = ROUNDS, seed: int = 7) -> Network:
    """The network after ``rounds`` passes of every shard, averaged after each pass.

    One row for each parameter and moment is collected a round.
    """
    state = np.zeros((3, len(Network.fresh(seed).flat())))
    state[0] = Network.fresh(seed).flat()
    shards = _sharded(learns, count)

    def trained(state: np.ndarray, turn: int) -> Callable:
        def run(key: tuple, table: pa.Table) -> pa.Table:
            table, codes, inside = _opened(table)
            own = train_round(state, turn * -(-len(codes) // 64), codes, inside,
                              table["label"].to_numpy().astype(float),
                              np.random.default_rng([seed, turn, key[0].as_py()])).ravel()
            return pa.table({"place": pa.array(np.arange(len(own), dtype=np.int32)),
                             "value": own * len(codes)})

        return run

    for turn in range(rounds):
        means = shards.applyInArrow(trained(state, turn), "place int, value double").groupBy(
            "place").agg(_exact(F.col("value")).alias("value")).toPandas()
        state = np.zeros_like(state)
        state.ravel()[means["place"]] = means["value"] / count
    return Network.of(state[0])


def by_rank(values: DataFrame, ranks: dict[int, int]) -> dict[int, float]:
    """For each kind the value x of that rank from 0 upwards, among (kind, x, n): n times x.

    Ranges that hold the value are cut into BINS parts until one value is left; a row for each
    part is collected.
    """
    found: dict[int, float] = {}
    span = {r.kind: (r.low, r.high, 0) for r in values.filter(F.col("kind").isin(*ranks)).groupBy(
        "kind").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect()}
    while span:
        found |= {k: low for k, (low, high, _) in span.items() if low == high}
        span = {k: v for k, v in span.items() if k not in found}
        if not span:
            break
        low, high = (F.element_at(F.create_map(*(F.lit(v) for k, s in span.items() for v in (
            k, s[i]))), F.col("kind")) for i in (0, 1))
        inside = values.filter(F.col("kind").isin(*span)).filter(F.col("x").between(low, high))
        part = F.least(F.floor((F.col("x") - low) / (high - low) * BINS), F.lit(BINS - 1))
        parts = inside.groupBy("kind", part.alias("part")).agg(
            F.sum("n").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
        for k, (_, _, below) in list(span.items()):
            for r in sorted((r for r in parts if r.kind == k), key=lambda r: r.part):
                if below + r.n > ranks[k]:
                    span[k] = r.low, r.high, below
                    break
                below += r.n
    return found


def _scored(held: DataFrame, count: int, net: Network) -> DataFrame:
    """(label, shape, n, x): the network's log odds of each window as it stands and without its
    surroundings, as it may stand elsewhere."""
    def run(table: pa.Table) -> pa.Table:
        table, codes, inside = _opened(table)
        x = [net.logits(c, inside) for c in (codes, without_surroundings(codes, inside))]
        table = table.select(["label", "shape", "n"])
        return pa.concat_tables([table.append_column("x", pa.array(v)) for v in x])

    return _sharded(held, count).applyInArrow(run, "label int, shape int, n long, x double")


def fit(docs: DataFrame) -> Detector | None:
    """A detector from the findings of all documents; none without findings of both labels.

    Repeated rows count as often as they stand, rows without an id like any other.  Without
    findings of both labels set aside, those that trained calibrate, and the other way round.
    """
    found = written(findings(docs))
    sizes = {(r.aside, r.label): r.n for r in found.groupBy("aside", "label").agg(
        F.count("*").alias("n")).collect()}
    if len({label for _, label in sizes}) < 2:
        return None

    def side(aside: bool) -> tuple[DataFrame, int]:
        if (aside, 0) in sizes and (aside, 1) in sizes:
            return found.filter(F.col("aside") == aside), sizes[aside, 0] + sizes[aside, 1]
        return found, sum(sizes.values())

    net = train(*side(False))
    scored = written(_scored(*side(True), net))
    counts = {(r.label, r["shape"]): r.n for r in scored.groupBy("label", "shape").agg(
        F.sum("n").alias("n")).collect()}
    ones, zeros = (sum(n for (label, _), n in counts.items() if label == y) for y in (1, 0))

    def sums(w: np.ndarray, targets: tuple[float, float]) -> tuple:
        x = F.col("x") / 10
        odds = F.greatest(F.least(x * float(w[0]) + float(w[1]), F.lit(30.0)), F.lit(-30.0))
        p = 1 / (1 + F.exp(-odds))
        h = F.col("n") * (p * (1 - p) + 1e-9)
        d = F.col("n") * (F.when(F.col("label") == 1, targets[1]).otherwise(targets[0]) - p)
        return tuple(scored.agg(*(_exact(v).alias(f"s{i}") for i, v in enumerate(
            (h * x * x, h * x, h, d * x, d)))).first())

    slope, offset = newton(ones, zeros, sums)
    # Kind -1 holds the secrets of all shapes.
    ranked = {s: n for (label, s), n in counts.items() if label == 1 and n >= FEWEST} | {-1: ones}
    secrets = scored.filter("label = 1").select(
        F.explode(F.array("shape", F.lit(-1))).alias("kind"), "x", "n")
    x = by_rank(secrets, {k: rank_for(n) for k, n in ranked.items()})
    detector = Detector(net, slope, offset, [])
    detector.thresholds = detector.odds(np.array([
        x.get(s, x[-1]) for s in range(len(SHAPES) + 1)])).tolist()
    return detector


def find_spans(texts: list[str], detector: Detector | None) -> list[list[tuple]]:
    """(start, end, kind, score) of all findings of each text, by start, then kind."""
    spans, owner, shown = [], [], []
    for text in texts:
        base = base_spans(text)
        spans.append([(b[0], b[1], b[2], 1.0) for b in base])
        for start, end in candidates(text, base) if detector else ():
            for window in windows(text, start, end):
                owner.append(len(spans) - 1)
                shown.append((*window, start, end))
    for at in range(0, len(shown), 4096):
        part = shown[at:at + 4096]
        scores = detector.scores(encode([w[0] for w in part]), insides(
            np.array([w[1] for w in part]), np.array([w[2] for w in part])))
        for i, (_, _, _, start, end), score in zip(owner[at:], part, scores.tolist()):
            if score >= detector.thresholds[shape(texts[i][start:end])]:
                last = spans[i][-1] if spans[i] else None
                if last and last[:3] == (start, end, "net"):  # another window of this token
                    score, _ = max(score, last[3]), spans[i].pop()
                spans[i].append((start, end, "net", score))
    return [sorted(s, key=lambda x: (x[0], KINDS.index(x[2]))) for s in spans]


SPANS = "array<struct<kind:string,start:long,end:long,score:double,value:string>>"


def find_secrets(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """(doc_id, spans) of every row of ``docs``: kind, start, end, score and text of each finding.

    Places are code points, ends exclusive; base findings score 1.  Base findings of two kinds may
    overlap, those of one kind do not.  A null text is an empty one.  Repeated rows each give a
    row, null ids are kept, an empty table gives an empty result.  Without findings to learn from
    there are base findings only.  Only doc_id and text are read.
    """
    detector = detector or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            found = [[{"kind": k, "start": a, "end": b, "score": s, "value": t[a:b]}
                      for a, b, k, s in spans]
                     for t, spans in zip(texts, find_spans(texts, detector))]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), (
                "end", pa.int64()), ("score", pa.float64()), ("value", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast(
        "string").alias("text")).mapInArrow(run, f"doc_id long, spans {SPANS}")


def secret_report(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row; see find_secrets."""
    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"], s["end"])), ",")

    found = F.col("spans")
    base = F.filter(found, lambda s: s["kind"] != "net")
    kinds = F.transform(found, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}")
              for k in KINDS[:3]]
    return find_secrets(docs, detector).select(
        "doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"),
        listed(found).alias("spans"))
