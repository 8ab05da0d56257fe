"""Grounding checks: names an answer uses against its context and the whole archive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T

# Label words an answer may use without a source, and common words.
TRUSTED = (
    "allégeance", "archive", "capacité", "capacités", "chronologie", "classe", "codex", "complète",
    "complètes", "doctrine", "faits", "fabricant", "fiche", "historiques", "manifestations",
    "mnémonique", "origine", "spécifications", "statistiques", "statut", "sous-titre", "tactiques",
    "territoire", "tissage", "type",
)
COMMON = (
    "ancien", "anciens", "conseil", "domination", "énergétique", "énergétiques", "espionnage",
    "militaire", "militaires", "manipulateur", "manipulateurs", "manipulatrice", "manipulatrices",
    "motivation", "motivations", "obsédé", "obsédée", "obsédés", "stratégie", "stratégies",
    "traître", "traîtres",
)
WORD = "([0-9A-Za-z_À-ÖØ-öø-ÿ]+)"
CAPITALISED = "^[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ]+$"
MARKUP = r"[*_>`#\-\[\](){}~]"
BOUNDARY = r"[.!?:]\s+"


def entities(text: Column) -> Column:
    """Capitalised words, lower-cased, except the first one of each sentence."""
    sentences = F.split(F.regexp_replace(text, MARKUP, " "), BOUNDARY)

    def names(s):
        caps = F.filter(F.regexp_extract_all(s, F.lit(WORD), F.lit(1)),
                        lambda w: F.rlike(w, F.lit(CAPITALISED)))
        return F.slice(caps, F.lit(2), F.greatest(F.size(caps), F.lit(1)))

    return F.array_distinct(F.transform(F.flatten(F.transform(sentences, names)), F.lower))


def is_ordinary(entity: Column, answer: Column, common: Sequence[str] = COMMON) -> Column:
    """A word that is no name: a common word, elided, or lower-case elsewhere in the answer."""
    key = T.fold_accents(entity)
    folded = F.translate(answer, T.ACCENTED, T.PLAIN)
    known = F.array(*[T.fold_accents(F.lit(w)) for w in common])
    edge = "[^0-9A-Za-z_À-ÿ]"
    elided = F.rlike(F.lower(folded), F.concat(
        F.lit(rf"(?:^|{edge})(?:l|d|qu)['’]\s*"), key, F.lit(rf"(?:{edge}|$)")))
    plain = F.rlike(folded, F.concat(F.lit(rf"(?:^|{edge})"), key, F.lit(rf"(?:{edge}|$)")))
    return F.array_contains(known, key) | elided | plain


def unsupported(answers: DataFrame, trusted: Sequence[str] = TRUSTED) -> DataFrame:
    """Entities of each answer that no spelling grounds in its context.

    ``answers`` has query_id, answer and context.  Grounding is by substring of the
    unaccented context; label words and ordinary words need no ground.
    """
    rows = T.once(answers.select("query_id", "answer", "context"), "corpus",
                  T.fold_accents(F.lower("context")))
    rows = rows.select("query_id", "answer", "corpus", F.explode(
        entities(F.col("answer"))).alias("entity"))
    grounded = F.exists(T.lexeme_forms(F.col("entity")),
                        lambda f: F.contains(F.col("corpus"), f))
    allowed = F.array(*[T.fold_accents(F.lit(w)) for w in trusted])
    return rows.filter(
        ~grounded & ~F.array_contains(allowed, T.fold_accents(F.col("entity")))
        & ~is_ordinary(F.col("entity"), F.col("answer"))).select("query_id", "entity")


def absent_from_archive(words: DataFrame, vocabulary: DataFrame, column: str) -> DataFrame:
    """Words none of whose spellings stands in the archive as a whole word.

    One equi-join against the vocabulary instead of one corpus scan per word.
    """
    distinct = words.select(column).distinct()
    known = distinct.select(column, F.explode(T.lexeme_forms(F.col(column))).alias("word")).join(
        vocabulary, "word", "left_semi").select(column).distinct()
    unknown = distinct.join(known, column, "left_anti")
    return words.join(unknown, column, "left_semi")


def missing_entity(rows: DataFrame, entity: str) -> DataFrame:
    """Queries whose entity is in none of their kept passages."""
    found = rows.groupBy("query_id", entity).agg(F.max(F.contains(
        F.lower("content"), F.lower(entity))).alias("found"))
    return found.withColumn("missing", F.col(entity).isNotNull() & ~F.col("found")).drop("found")
