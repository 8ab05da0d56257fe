"""Joins against lookup tables whose size is only known at run time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.session import materialize

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
SALTS = 32


def _row_bytes(df: DataFrame) -> Column:
    """Bytes of a row: its texts (of nested values the JSON form) and eight for each number."""
    total = F.lit(0)
    for field in df.schema.fields:
        kind, value = field.dataType.typeName(), F.col(f"`{field.name}`")
        if kind in ("string", "binary"):
            total += F.coalesce(F.octet_length(value), F.lit(0)) + 16
        elif kind in ("array", "map", "struct"):
            total += F.coalesce(F.length(F.to_json(F.struct(value))), F.lit(0)) + 16
        else:
            total += F.lit(8)
    return total.cast("long")


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS,
                   max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a (materialised) table is small enough to broadcast, in rows and in bytes."""
    size = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(_row_bytes(df)), F.lit(0)).alias(
        "bytes")).first()
    return size["n"] <= max_rows and size["bytes"] <= max_bytes


def lookup_join(left: DataFrame, lookup: DataFrame, keys: Sequence[str], spread: Column,
                how: str = "inner", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a large table to a lookup with one row per key, whatever the key skew.

    A lookup of checked size is broadcast.  A larger one is repeated per salt, and
    ``spread`` (any evenly distributed column of the left side, such as its id) deals the
    rows of a hot key over the salts; the result is the same.
    """
    lookup = materialize(lookup)
    if fits_broadcast(lookup, max_rows):
        return left.join(F.broadcast(lookup), list(keys), how)
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = lookup.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "__salt"], how).drop("__salt")
