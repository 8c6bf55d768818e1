"""Repeatable draws: every random choice is a hash of (seed, row key), so a re-run and a retried task agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curate.functions.base import ColumnLike, col


def seeded_key(seed: int | ColumnLike, *key: ColumnLike) -> Column:
    """md5 of 'seed:key1:key2...' as hex text; other systems can compute the same."""
    head = F.lit(str(seed)) if isinstance(seed, int) else col(seed).cast("string")
    return F.md5(F.concat_ws(":", head, *[col(k).cast("string") for k in key]))


def key_number(key: Column) -> Column:
    """The first 32 bits of a seeded key, 0 .. 2^32-1."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long")


def seeded_int(seed: int | ColumnLike, bound: int, *key: ColumnLike) -> Column:
    """A draw from 0 .. bound-1."""
    return F.pmod(key_number(seeded_key(seed, *key)), F.lit(bound)).cast("int")
