"""Joins and ordered scans that stay balanced when one key holds a large share of the rows.

Two tools carry the rest of the package:

* ``join_unique`` attaches one row per key to many rows per key, in a form whose hot partitions
  adaptive execution can split.
* ``running`` is a running aggregate over an integer order. Windows are cut into segments of about
  ``SPAN`` rows; the result of the earlier segments is added by a join on one row per (key, segment).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from curate.functions.base import cols

SPAN = 100_000


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type in which keys of two types are compared; an error where none holds both without loss."""
    if a == b:
        return a
    if isinstance(a, _WHOLE) and isinstance(b, _WHOLE):
        return T.LongType()
    if isinstance(a, T.StringType) and isinstance(b, T.StringType):
        return T.StringType()
    if isinstance(a, (T.FloatType, T.DoubleType)) and isinstance(b, (T.FloatType, T.DoubleType)):
        return T.DoubleType()
    times = (T.DateType, T.TimestampType)
    if isinstance(a, times) and isinstance(b, times):
        return T.TimestampType()
    whole = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}
    digits = []
    for kind in (a, b):
        if isinstance(kind, T.DecimalType):
            digits.append((kind.precision - kind.scale, kind.scale))
        elif isinstance(kind, _WHOLE):
            digits.append((whole[type(kind)], 0))
    if len(digits) == 2:
        before, after = max(x for x, _ in digits), max(x for _, x in digits)
        if before + after <= 38:
            return T.DecimalType(before + after, after)
    raise TypeError(f"keys of {a.simpleString()} and {b.simpleString()} cannot be joined without loss: cast one side")


def null_safe(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join on key columns where NULL equals NULL; the left side's key columns stay. Without keys the right side is one row."""
    on = cols(on)
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    match = reduce(lambda a, b: a & b, [left[c].eqNullSafe(renamed[f"_r_{c}"]) for c in on], F.lit(True))
    if not on:
        return left.join(F.broadcast(renamed), match, how)
    return left.join(renamed, match, how).drop(*[f"_r_{c}" for c in on])


def join_unique(df: DataFrame, facts: DataFrame, on, how: str = "left") -> DataFrame:
    """Join ``facts`` (one row per key) to ``df`` (any number of rows per key); left, inner, semi or anti.

    Adaptive execution splits the hot partitions of a sort-merge join only where both inputs come
    straight from the join's own shuffles. Facts that were just aggregated by the key would be joined
    in place; the key's hash as a second join key makes the join shuffle them (one row per key) itself.
    Small facts still become a broadcast by their measured size.
    """
    on = cols(on)
    # Equal values of different types have different hashes, so both sides hash the common type.
    kinds = [common_type(df.schema[c].dataType, facts.schema[c].dataType) for c in on]
    key_hash = F.xxhash64(*[F.col(c).cast(kind) for c, kind in zip(on, kinds, strict=True)])
    left, right = df.withColumn("_hash", key_hash), facts.withColumn("_hash", key_hash)
    return left.join(right, [*on, "_hash"], how).drop("_hash")


_MERGE: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
_LOCAL: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def _combine(how: str, a: Column, b: Column) -> Column:
    if how == "min":
        return F.least(a, b)
    if how == "max":
        return F.greatest(a, b)
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)) if how == "count" else F.coalesce(a + b, a, b)


def _width(by: list[str], df: DataFrame, order: str, span: int) -> DataFrame:
    """(by..., _n, _lo, _width): where the orders of a group begin, and how many order values hold ``span`` rows on average."""
    ends = df.groupBy(*by).agg(
        F.count(order).alias("_n"), F.min(order).cast("double").alias("_lo"), F.max(order).cast("double").alias("_hi")
    )
    step = F.greatest(F.lit(1.0), (F.col("_hi") - F.col("_lo") + 1) / F.greatest(F.col("_n"), F.lit(1)))
    return ends.select(*by, "_n", F.col("_lo"), (step * span).alias("_width"))


def _segments(df: DataFrame, key: list[str], order: str, span: int) -> DataFrame:
    """Add ``_seg``, a struct that sorts like the order inside a key.

    First by the key's mean step; a segment that orders crowd into is cut again by its own mean step.
    """

    def place(name: str):
        return F.floor((F.col(order) - F.col("_lo")) / F.col("_width")).alias(name)

    ends, by = _width(key, df, order, span), [*key, "_s1"]
    # Only keys of more rows can have a crowded segment: where there are none, adaptive execution drops this branch.
    large = null_safe(df.select(*dict.fromkeys([*key, order])), ends.where(F.col("_n") > 2 * span), key)
    crowded = _width(by, large.select(*key, order, place("_s1")), order, span).where(F.col("_n") > 2 * span).drop("_n")
    coarse = null_safe(df, ends, key, "left").select(*df.columns, place("_s1"))
    fine = null_safe(coarse, crowded, by, "left")
    second = F.coalesce(F.floor((F.col(order) - F.col("_lo")) / F.col("_width")), F.lit(0)).alias("s2")
    return fine.withColumn("_seg", F.struct(F.col("_s1").alias("s1"), second)).drop("_s1", "_lo", "_width")


def running(df: DataFrame, key, order: str, measures: dict[str, tuple[str, Column]], span: int = SPAN) -> DataFrame:
    """Add running aggregates from the first row of the key up to the current row.

    ``order`` is an integer column, unique within the key. ``measures`` maps a new column name to
    (sum | count | min | max, column). Segments are as wide as the key's mean step asks for, so orders with
    large steps (times, say) are cut into as few segments as dense ones; segments that turn out crowded are
    cut once more.
    """
    key = cols(key)
    cut = _segments(df, key, order, span)
    local = Window.partitionBy(*key, "_seg").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = cut.withColumns({n: _LOCAL[how](c).over(local) for n, (how, c) in measures.items()})
    per_segment = cut.groupBy(*key, "_seg").agg(*[_LOCAL[how](c).alias(f"_{n}") for n, (how, c) in measures.items()])
    earlier = Window.partitionBy(*key).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        per_segment.withColumn("_first", F.min("_seg").over(Window.partitionBy(*key)))
        .withColumns({f"_{n}": _MERGE[how](f"_{n}").over(earlier) for n, (how, _) in measures.items()})
        .where(F.col("_seg") > F.col("_first"))
        .drop("_first")
    )
    joined = null_safe(rows, carried, [*key, "_seg"], "left")
    merged = {n: _combine(how, F.col(n), F.col(f"_{n}")) for n, (how, _) in measures.items()}
    return joined.withColumns(merged).drop("_seg", *[f"_{n}" for n in measures])
