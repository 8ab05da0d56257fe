"""Mixing sources to target weights: a min-cost flow over membership patterns, then selection.

Documents that belong to the same set of sources are one *pattern*.  Only one row per pattern
reaches the driver.  There a flow routes words from patterns to the sources' quotas; reading a
pattern once costs nothing, a second and third time cost more and more (convex), so repetition is
spread as evenly as the quotas allow.  Each pattern's share is then taken in a seeded order of
its documents: whole passes first, then a prefix of the order, found by a histogram of the
order's hash and one exact look into the bin where the prefix ends.  What the prefix leaves free
is filled with the largest documents that fit, until none fits.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.skew import fits_broadcast
from foliant.session import written

SEED = 42
REPEATS = 3  # no document is taken more often
BINS = 4096  # of the order's hash
HASH_BITS = 60
BROADCAST_PATTERNS = 100_000
WORD = r"[^\x20\x09-\x0D]+"

Pattern = tuple[str | None, ...]


def by_code_point(name: str | None) -> tuple:
    """Order of source names: code points, null last."""
    return (name is None, name or "")


def cyclic_weights(names: Sequence[str | None], cycle: Sequence[int] = (1, 2, 3)) -> dict:
    """Weights 1, 2, 3, 1, ... of the sources in order."""
    ordered = sorted(names, key=by_code_point)
    return {name: cycle[i % len(cycle)] for i, name in enumerate(ordered)}


def target_words(sizes: Mapping[str | None, int], weights: Mapping[str | None, int],
                 total: int, repeats: int = REPEATS) -> dict[str | None, Fraction]:
    """Shares of ``total`` by weight; none above ``repeats`` sizes, the excess shared anew."""
    open_, out, left = set(sizes), {}, Fraction(total)
    while open_:
        unit = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if unit * weights[s] > repeats * sizes[s]}
        if not full:
            return out | {s: unit * weights[s] for s in open_}
        for s in full:
            out[s] = Fraction(repeats * sizes[s])
            left -= out[s]
        open_ -= full
    return out


def route(capacity: Mapping[Pattern, int], quota: Mapping[str | None, int],
          repeats: int = REPEATS) -> dict[tuple[Pattern, str | None], int]:
    """Words from each pattern to each source: the largest flow at the least repetition cost.

    Successive shortest paths.  A path leaves through a pattern's cheapest pass with room, and
    may take words back from a source that another pattern can serve.  The k-th pass costs
    k * k a word.
    """
    used = {p: 0 for p in capacity}
    flow: dict[tuple[Pattern, str | None], int] = {}
    served = {s: 0 for s in quota}
    members: dict[str | None, list[Pattern]] = {}
    for p in capacity:
        for s in p:
            members.setdefault(s, []).append(p)

    def room(p: Pattern) -> tuple[int, int]:
        """Cost of the pattern's next pass, and the words left in it."""
        k = used[p] // capacity[p]
        return (k + 1) ** 2, (k + 1) * capacity[p] - used[p]

    for source in sorted(quota, key=by_code_point):
        while served[source] < quota[source]:
            # Cheapest pattern that reaches this source, directly or by taking over for another.
            best: dict[Pattern, Pattern | None] = {}
            via: dict[Pattern, str | None] = {}
            edge = [p for p in members.get(source, ()) if capacity[p]]
            for p in edge:
                best[p], via[p] = None, source
            open_, seen = list(edge), set(edge)
            found = None
            while open_:
                p = open_.pop()
                if used[p] < repeats * capacity[p]:
                    cost = (room(p)[0], [by_code_point(s) for s in p], p)
                    if found is None or cost[:2] < found[:2]:
                        found = cost
                for s in p:  # p may serve `source` and leave s to someone else
                    if flow.get((p, s), 0) > 0 and s != via[p]:
                        for other in members.get(s, ()):
                            if other not in seen and capacity[other]:
                                seen.add(other)
                                best[other], via[other] = p, s
                                open_.append(other)
            if found is None:
                break
            p = found[2]
            amount = min(quota[source] - served[source], room(p)[1])
            step, chain = p, []
            while step is not None:
                chain.append(step)
                step = best[step]
            for nearer, farther in zip(chain[1:], chain):
                amount = min(amount, flow[nearer, via[farther]])
            used[p] += amount
            for i, q in enumerate(chain):
                flow[q, via[q]] = flow.get((q, via[q]), 0) + amount
                if i + 1 < len(chain):
                    flow[chain[i + 1], via[q]] -= amount
            served[source] += amount
    return {k: v for k, v in flow.items() if v}


@dataclass(frozen=True)
class Mix:
    """What was decided: sources' sizes, weights and targets, and one share per pattern."""

    sizes: dict
    targets: dict
    plan: DataFrame  # pattern, rounds, cut (a place in the order)
    picks: DataFrame | None  # pattern, nameless, unit that fill what the prefixes leave


def _order_hash(nameless: Column, unit: Column, seed: int) -> Column:
    """A 60-bit hash that orders documents, the same in any engine."""
    name = F.concat(F.when(nameless, f"{seed}:row ").otherwise(f"{seed}:"), unit.cast("string"))
    return _hash60(name)


def _place() -> Column:
    return F.struct("hash", "nameless", "unit")


def _hash60(text: Column) -> Column:
    """The first 60 bits of the text's md5, as a number."""
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def _told_apart(docs: DataFrame, source: str) -> DataFrame:
    """``docs`` with __nameless and __unit: the doc_id, or a number of its own for a row without.

    Rows without an id are numbered by their text and, among equal texts of a source, from 1 on,
    so that there are the same numbers however the rows are dealt.
    """
    doc_id = F.col("doc_id").cast("long")
    named = docs.withColumns({"__nameless": F.lit(False), "__unit": doc_id}).filter(
        F.col("__unit").isNotNull())
    nameless = docs.filter(doc_id.isNull())
    if nameless.isEmpty():
        return named
    # Equal rows may be very many: each partition numbers its own, from where the one before ends.
    key = ["__pattern", "__content", "__part"]
    rows = written(nameless.withColumns({
        "__pattern": _pattern_key(_members(docs, source)), "__part": F.spark_partition_id(),
        "__content": F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))}))
    before = rows.groupBy(*key).count().withColumn("__before", F.sum("count").over(
        Window.partitionBy(*key[:2]).orderBy("__part").rowsBetween(
            Window.unboundedPreceding, -1))).drop("count")
    number = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1)))
    numbered = rows.withColumn("__number", number).join(before, key)
    unit = _hash60(F.concat_ws(":", "__content", F.col("__number") + F.coalesce(
        "__before", F.lit(0))))
    return named.unionByName(written(numbered.withColumns(
        {"__nameless": F.lit(True), "__unit": unit}).select(*named.columns)))


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _members(docs: DataFrame, source: str) -> Column:
    """Sorted set of sources of a row: of an array column its elements, else the one value."""
    kind = docs.schema[source].dataType.typeName()
    one = F.array(F.col(source).cast("string"))
    several = F.col(source)
    return F.array_sort(F.array_distinct(F.coalesce(several, one))) if kind == "array" else one


def _pattern_key(members: Column) -> Column:
    """Text that names a pattern, null elements included."""
    return F.to_json(F.transform(members, lambda s: F.coalesce(F.concat(F.lit("s"), s),
                                                               F.lit("n"))))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_PATTERNS else df


def plan_mix(docs: DataFrame, source: str = "source", seed: int = SEED, repeats: int = REPEATS,
             weights: Callable[[Sequence], Mapping] = cyclic_weights) -> Mix:
    """Decide what to take of ``docs`` (doc_id, text, source or array of sources)."""
    return _plan(_told_apart(docs, source), source, seed, repeats, weights)


def _plan(docs: DataFrame, source: str = "source", seed: int = SEED, repeats: int = REPEATS,
          weights: Callable[[Sequence], Mapping] = cyclic_weights) -> Mix:
    spark = docs.sparkSession
    members = _members(docs, source)
    sized = written(docs.select(
        F.col("__nameless").alias("nameless"), F.col("__unit").alias("unit"),
        _pattern_key(members).alias("pattern"), members.alias("members"),
        word_count(F.col("text").cast("string")).alias("size")))
    totals = sized.groupBy("pattern").agg(F.first("members").alias("members"),
                                          F.sum("size").alias("size")).collect()
    sizes: dict = {}
    for r in totals:
        for s in r.members:
            sizes[s] = sizes.get(s, 0) + r.size
    targets = target_words(sizes, weights(list(sizes)), sum(r.size for r in totals), repeats)
    capacity = {tuple(r.members): r.size for r in totals}
    key = {tuple(r.members): r.pattern for r in totals}
    flow = route(capacity, {s: int(t) for s, t in targets.items()}, repeats)
    taken = {p: 0 for p in capacity}
    for (p, _), words in flow.items():
        taken[p] += words
    shares = spark.createDataFrame(
        [(key[p], taken[p] // size if size else 0, taken[p] % size if size else 0)
         for p, size in capacity.items()], "pattern string, rounds long, remainder long")
    return Mix(sizes, targets, *_cuts(sized, shares, len(capacity), seed))


def _crossing(counts: DataFrame, limit: str, order: Column, keep: Sequence[str]) -> DataFrame:
    """Of each pattern the first row of ``counts`` at which the sum of "n" is above ``limit``.

    Columns: pattern, ``keep``, ``limit`` and before, the sum up to the row.
    """
    upto = Window.partitionBy("pattern").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    above = counts.withColumn("sum", F.sum("n").over(upto)).filter(F.col("sum") > F.col(limit))
    # Counts are not negative, so the first row above the limit is the one of the least sum.
    first = F.min(F.struct("sum", order.alias("at"), *keep, limit,
                           (F.col("sum") - F.col("n")).alias("before"))).alias("first")
    return above.filter("n > 0").groupBy("pattern").agg(first).select(
        "pattern", *[f"first.{c}" for c in (*keep, limit, "before")])


def _cuts(sized: DataFrame, shares: DataFrame, patterns: int,
          seed: int) -> tuple[DataFrame, DataFrame | None]:
    """Where each pattern's prefix ends in the seeded order, and what fills the rest."""
    units = sized.groupBy("pattern", "nameless", "unit").agg(
        F.sum("size").alias("size")).withColumn(
        "hash", _order_hash(F.col("nameless"), F.col("unit"), seed)).withColumn(
        "bin", F.shiftright("hash", HASH_BITS - BINS.bit_length() + 1))
    units = written(units.join(_small(shares.filter("remainder > 0"), patterns), "pattern"))
    bins = units.groupBy("pattern", "bin").agg(
        F.sum("size").alias("n"), F.first("remainder").alias("remainder"))
    crossing = written(_crossing(bins, "remainder", F.col("bin"), ["bin"]).drop("remainder"))
    inside = units.join(_small(crossing, patterns), ["pattern", "bin"]).withColumn(
        "sum", F.col("before") + F.sum("size").over(
            Window.partitionBy("pattern").orderBy("hash", "nameless", "unit")))
    # The prefix ends before the first document that no longer fits.
    cut = written(inside.filter("sum > remainder").groupBy("pattern").agg(
        F.min(_place()).alias("cut"), F.min("sum").alias("sum"),
        F.min_by("size", _place()).alias("size"),
        F.first("remainder").alias("remainder")).select(
        "pattern", "cut", (F.col("remainder") - F.col("sum") + F.col("size")).alias("gap")))
    rest = written(units.drop("rounds", "remainder").join(_small(cut, patterns), "pattern").filter(
        (_place() >= F.col("cut")) & (F.col("size") > 0) & (F.col("size") <= F.col("gap")))
        .drop("cut"))
    picks = None
    # Each pass takes the largest documents up to the first that does not fit, at least one; what
    # is left then is less than half of the gap, so the passes are logarithmic in it.
    while not rest.isEmpty():
        stops = _stops(rest, patterns)
        seen = rest.join(_small(stops, patterns), "pattern", "left")
        chosen = written(seen.filter(
            F.col("stop").isNull() | (F.col("size") > F.col("stop_size"))
            | ((F.col("size") == F.col("stop_size")) & (_place() < F.col("stop")))).select(
            "pattern", "nameless", "unit"))
        picks = chosen if picks is None else picks.union(chosen)
        rest = written(seen.filter(F.col("size") <= F.col("left")).select(
            "pattern", "nameless", "unit", "size", "hash", "bin", F.col("left").alias("gap")))
    plan = written(shares.join(_small(cut.drop("gap"), patterns), "pattern", "left"))
    return _small(plan, patterns), picks


def _stops(rest: DataFrame, patterns: int) -> DataFrame:
    """(pattern, stop_size, stop, left): where the largest documents no longer fit the gap.

    Sizes above stop_size fit whole, of stop_size the documents before the place ``stop``, and
    ``left`` words stay free.  A pattern whose every document fits is not returned.
    """
    sizes = rest.groupBy("pattern", "size").agg(
        (F.count("*") * F.col("size")).alias("n"), F.first("gap").alias("gap"))
    last = written(_crossing(sizes, "gap", -F.col("size"), ["size"]).withColumn(
        "room", F.expr("(gap - before) div size")).select(
        "pattern", "size", "room", (F.col("gap") - F.col("before") - F.col("room") * F.col(
            "size")).alias("left")))
    level = rest.drop("gap").join(_small(last, patterns), ["pattern", "size"])
    bins = level.groupBy("pattern", "bin").agg(
        F.count("*").alias("n"), F.first("room").alias("room"))
    crossing = _crossing(bins, "room", F.col("bin"), ["bin"]).drop("room")
    number = F.row_number().over(
        Window.partitionBy("pattern").orderBy("hash", "nameless", "unit"))
    return written(level.join(_small(crossing, patterns), ["pattern", "bin"]).withColumn(
        "number", F.col("before") + number).filter(F.col("number") == F.col("room") + 1).select(
        "pattern", F.col("size").alias("stop_size"), _place().alias("stop"), "left"))


def _with_copies(docs: DataFrame, mix: Mix, source: str = "source",
                 seed: int = SEED) -> DataFrame:
    """All columns of ``docs`` but __nameless and __unit, and __copies, how often the mix takes
    the row (0 to REPEATS)."""
    plan = mix.plan.withColumnsRenamed({c: f"__{c}" for c in mix.plan.columns})
    place = F.struct(_order_hash(F.col("__nameless"), F.col("__unit"), seed).alias("hash"),
                     F.col("__nameless").alias("nameless"), F.col("__unit").alias("unit"))
    marked = docs.withColumn("__key", _pattern_key(_members(docs, source))).join(
        plan, F.col("__key") == F.col("__pattern"), "left")
    more = F.coalesce(place < F.col("__cut"), F.lit(False))
    extra = ["__key", "__nameless", "__unit", *plan.columns]
    if mix.picks is not None:
        picks = mix.picks.select(
            F.col("pattern").alias("__key"), F.col("nameless").alias("__nameless"),
            F.col("unit").alias("__unit"), F.lit(True).alias("__picked"))
        marked = marked.join(F.broadcast(picks) if fits_broadcast(picks) else picks,
                             ["__key", "__nameless", "__unit"], "left")
        more |= F.col("__picked").isNotNull()
        extra.append("__picked")
    return marked.withColumn(
        "__copies", F.coalesce("__rounds", F.lit(0)) + more.cast("long")).drop(*extra)


def mix_documents(docs: DataFrame, source: str = "source", seed: int = SEED) -> DataFrame:
    """The rows of the mix, all columns; a document taken k times gives k rows.

    A null source is a source of its own, a document with a null or blank text has no words and
    is taken as often as whole passes are.  Rows that repeat a doc_id within a pattern are taken
    or left together; each row without one is a document of its own, and of rows without one that
    share text and sources any may be the ones taken.  An empty table gives an empty mix.
    """
    rows = _told_apart(docs, source)
    counted = _with_copies(rows, _plan(rows, source, seed), source, seed).filter("__copies > 0")
    return counted.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop(
        "__copies", "__copy")


def mix_report(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of ``docs`` with one source each.

    taken is the words that the mix reads of the row, repeats counted; see mix_documents for
    nulls, repeated rows and empty tables.  Only doc_id, text and source are read.
    """
    rows = _told_apart(docs.select("doc_id", F.col("source").cast("string").alias("source"),
                                   F.col("text").cast("string").alias("text")), "source")
    mix = _plan(rows, "source", seed)
    facts = docs.sparkSession.createDataFrame(
        [("n" if s is None else "s" + s, int(size), round(float(mix.targets[s]), 6))
         for s, size in mix.sizes.items()], "__s string, source_size long, target double")
    counted = _with_copies(rows.withColumn("size", word_count(F.col("text"))), mix, "source", seed)
    named = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    return counted.join(_small(facts, len(mix.sizes)), named == F.col("__s")).select(
        F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * F.col("__copies")).alias("taken"))
