"""As-of join of two tables: every row takes the nearest earlier (or later) row of its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curate.functions.base import cols
from curate.operators.skew import SPAN, running

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _place(df: DataFrame, name: str) -> Column:
    """A time or number as a whole number of the same order: days, microseconds, or the number's own last digit."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(name).cast("long")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp"))
    if isinstance(kind, _WHOLE):
        return F.col(name).cast("long")
    if isinstance(kind, T.DecimalType) and kind.precision <= 17:
        return (F.col(name) * F.lit(10**kind.scale)).cast("long")
    raise TypeError(f"{name} is {kind.simpleString()}: an as-of join needs dates, timestamps, whole numbers or decimals of up to 17 digits")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by,
    left_on: str,
    right_on: str,
    values,
    forward: bool = False,
    strict: bool = False,
    tolerance: int | None = None,
    tie=(),
    span: int = SPAN,
) -> DataFrame:
    """Add ``values`` of the last row of ``right`` with the same ``by`` and ``right_on`` <= ``left_on``; NULL without one.

    ``forward`` takes the first row with ``right_on`` >= ``left_on``; ``strict`` leaves out equality; ``tolerance`` is the
    largest distance that counts, in days for dates, microseconds for timestamps, else in units of the last digit. Of several
    rows of ``right`` at one place the last by ``tie``, then by ``values``, counts (the first with ``forward``). Rows with a NULL
    in ``by`` or ``left_on`` stay, without values; such rows of ``right`` are passed over. Both places must be of one type.

    Both sides go into one table, ordered by place, and the last row of ``right`` is carried along as a running maximum. So a
    key of any size is cut into segments (``running``), and no row of ``left`` is ever multiplied.
    """
    by, values, tie = cols(by), cols(values), cols(tie)
    kinds = {type(left.schema[left_on].dataType), type(right.schema[right_on].dataType)}
    if len(kinds) > 1 and not all(issubclass(k, _WHOLE) for k in kinds):
        raise TypeError(f"{left_on} and {right_on} are of two types")
    if isinstance(left.schema[left_on].dataType, T.DecimalType) and left.schema[left_on].dataType.scale != right.schema[right_on].dataType.scale:
        raise TypeError(f"{left_on} and {right_on} have not the same number of digits after the point")
    sign = -1 if forward else 1
    # Rows of the right side stand before rows of the left at the same place, or after them where equality is left out.
    first, second = (1, 0) if strict else (0, 1)
    picked = F.struct(F.col("_at"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(tie)], *[F.col(c).alias(f"_v{i}") for i, c in enumerate(values)])
    facts = right.dropna(subset=[*by, right_on]).withColumn("_at", _place(right, right_on))
    facts = facts.select(*by, (sign * 2 * F.col("_at") + first).alias("_order"), picked.alias("_pick"))
    rest = [c for c in left.columns if c not in by]
    whole = F.struct(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(rest)]) if rest else F.struct(F.lit(1).alias("_c"))
    rows = left.select(*by, _place(left, left_on).alias("_at"), whole.alias("_left"))
    located = " and ".join(f"`{c}` is not null" for c in (*by, "_at")) or "true"
    asked = rows.where(located).select(*by, (sign * 2 * F.col("_at") + second).alias("_order"), "_at", "_left")
    both = asked.unionByName(facts, allowMissingColumns=True)
    carried = running(both, by, "_order", {"_near": ("min" if forward else "max", F.col("_pick"))}, span).where(F.col("_left").isNotNull())
    unplaced = rows.where(f"not ({located})").select(*by, "_at", "_left")
    out = carried.select(*by, "_at", "_left", "_near").unionByName(unplaced, allowMissingColumns=True)
    near = F.col("_near")
    if tolerance is not None:
        near = F.when(F.abs(F.col("_at") - F.col("_near._at")) <= tolerance, near)
    out = out.withColumn("_near", near)
    kept = [F.col(f"_left._c{rest.index(c)}").alias(c) if c in rest else F.col(c) for c in left.columns]
    return out.select(*kept, *[F.col(f"_near._v{i}").alias(v) for i, v in enumerate(values)])
