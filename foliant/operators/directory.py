"""Names and directories: lookups, media chains, members, roles, subjects, aliases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators.skew import lookup_join

MIN_TOKEN = 3


def resolve_keys(rows: DataFrame, key: str, dictionary: DataFrame) -> DataFrame:
    """Localized text of a key, the key itself when the dictionary lacks it."""
    d = dictionary.select(F.col("key").alias(key), "text")
    return lookup_join(rows, d, [key], F.monotonically_increasing_id(), "left").withColumn(
        "text", F.coalesce("text", F.col(key)))


def media_lookup(titles: DataFrame, names: DataFrame, textures: DataFrame) -> DataFrame:
    """Title → normalised name → entity id → texture → file name."""
    keyed = titles.withColumn("name_key", T.normalize_key(F.col("page_title")))
    by_name = names.groupBy(T.normalize_key(F.col("name")).alias("name_key")).agg(
        F.min_by("entity_id", "position").alias("entity_id"))
    found = lookup_join(keyed, by_name, ["name_key"], F.col("page_id"))
    files = textures.select("entity_id", T.sanitize_filename(F.col("texture")).alias("file_name"))
    return found.join(files, "entity_id").drop("name_key")


def first_per_bucket(rows: DataFrame, bucket: str, value: str, order: str) -> DataFrame:
    return rows.groupBy(bucket).agg(F.min_by(value, order).alias(value))


def name_tokens(text: Column) -> Column:
    """Distinct lower-case word tokens long enough to be a typed name."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-zà-ÿ][0-9a-z_à-ÿ]*)"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= MIN_TOKEN))


def resolve_members(messages: DataFrame, names: DataFrame, stopwords: Sequence[str],
                    key: str) -> DataFrame:
    """Token of each message that names a member.

    An exact name beats the longest token that begins a name; stop words never count as
    beginnings; ties go to the alphabetically first token.  The beginnings of all names
    are spelled out once, so both tests are equi-joins.
    """
    folded = names.select(T.fold_leet(T.strip(F.lower("name"))).alias("name")).filter(
        "name <> ''").distinct()
    starts = folded.select("name", F.explode(F.transform(
        F.sequence(F.lit(MIN_TOKEN), F.greatest(F.length("name"), F.lit(MIN_TOKEN))),
        lambda n: F.substring("name", F.lit(1), n))).alias("folded"))
    table = starts.groupBy("folded").agg(F.max(F.col("name") == F.col("folded")).alias("exact"))
    tokens = messages.select(key, F.explode(name_tokens(F.col("text"))).alias("token")).withColumn(
        "folded", T.fold_leet(F.col("token")))
    hits = lookup_join(tokens, table, ["folded"], F.col(key)).filter(
        F.col("exact") | ~F.col("token").isin(*stopwords))
    rank = F.struct((~F.col("exact")).alias("a"), F.when(F.col("exact"), 0).otherwise(
        -F.length("token")).alias("b"), F.col("token").alias("c"))
    return hits.groupBy(key).agg(F.min_by("token", rank).alias("token"),
                                 F.min_by("exact", rank).alias("exact"))


def accreditation(members: DataFrame, owned: DataFrame, priorities: Sequence[tuple[str, str]],
                  default: str, founder: str) -> DataFrame:
    """Status of the highest-priority configured role of each member, else the default."""
    order = F.coalesce(*[F.when(F.col("role") == r, F.lit(i)) for i, (r, _) in enumerate(priorities)])
    status = F.coalesce(*[F.when(F.col("role") == r, F.lit(s)) for r, s in priorities])
    best = owned.withColumn("rank", order).withColumn("status", status).groupBy("user_id").agg(
        F.min_by("status", "rank").alias("status"),
        F.max(F.col("role") == founder).alias("founder"))
    return members.join(best, "user_id", "left").select(
        "user_id", F.coalesce("status", F.lit(default)).alias("status"),
        F.coalesce("founder", F.lit(False)).alias("founder"))


def match_roles(configured: DataFrame, present: DataFrame) -> DataFrame:
    """Configured role names matched to present ones, ignoring case and accents.

    The first present role of a name wins; unmatched ones keep a null id.
    """
    def fold(c):
        return T.squeeze(T.fold_accents(F.lower(c)))

    first = present.groupBy(fold(F.col("name")).alias("folded")).agg(
        F.min("role_id").alias("role_id"))
    wanted = configured.withColumn("folded", fold(F.col("name")))
    return lookup_join(wanted, first, ["folded"], F.monotonically_increasing_id(), "left").drop(
        "folded")


def context_subjects(contexts: DataFrame, prefix: str, stop: Sequence[str]) -> DataFrame:
    """Subjects named by prefixed conversation contexts, comma by comma, letters only."""
    c = F.trim(F.col("context"))
    kept = contexts.select("context").distinct().filter(
        F.startswith(F.upper(c), F.lit(prefix.upper()))
        & ~F.exists(F.array(*[F.lit(s) for s in stop]), lambda s: F.contains(F.lower(c), s)))
    parts = F.split(F.substring(c, F.lit(len(prefix) + 1), F.length(c)), ",")
    words = F.transform(parts, lambda p: F.lower(F.array_join(F.regexp_extract_all(
        p, F.lit("([A-Za-zÀ-ÖØ-öø-ÿ]+)"), F.lit(1)), " ")))
    return kept.select(F.explode(words).alias("subject")).filter("subject <> ''").distinct()


def grouped_listing(rows: DataFrame, group: str, key: str, order: Sequence[str]) -> DataFrame:
    """Mapping rows in a fixed group order, unknown groups last, keys sorted within.

    Rows carry their sort position, so the listing is written with one range sort.
    """
    place = F.coalesce(*[F.when(F.col(group) == g, F.lit(i)) for i, g in enumerate(order)],
                       F.lit(len(order)))
    return rows.withColumn("group_rank", place).orderBy("group_rank", key)


def page_cast(sections: DataFrame, directory: DataFrame, previous: DataFrame) -> DataFrame:
    """Section names also known to the directory; the previous list when there are none."""
    found = sections.join(directory, "name", "left_semi").select("name").distinct()
    none = found.limit(1).agg((F.count("*") == 0).alias("empty"))  # one row
    kept = previous.join(F.broadcast(none), F.col("empty")).select("name")
    return found.unionByName(kept)


def poly_text(value: Column) -> Column:
    """Text of a loosely typed JSON value: string, list, object with a name, or scalar."""
    text = F.trim(value)
    quoted = F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v")

    def clean(c):
        return F.nullif(F.trim(c), F.lit(""))

    items = F.from_json(text, "array<string>")
    named = F.coalesce(*[F.get_json_object(text, f"$.{k}") for k in ("name", "value", "0")])
    joined = F.array_join(F.filter(items, lambda x: F.length(F.trim(x)) > 0), " ")
    return F.when(F.startswith(text, F.lit("[")), clean(joined)).when(
        F.startswith(text, F.lit("{")), clean(named)).when(text == "null", None).otherwise(
        clean(quoted))


def roster_names(roles: Column, defaults: Sequence[str]) -> Column:
    """Role names to show: neither blank nor default, in their order."""
    skip = F.array(*[F.lit(d) for d in defaults])
    return F.filter(F.transform(roles, T.strip),
                    lambda r: (r != "") & ~F.array_contains(skip, F.lower(r)))
