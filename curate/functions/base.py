"""Small helpers shared by the column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cols(names) -> list[str]:
    """A column name or a list of them, as a list."""
    return [names] if isinstance(names, str) else list(names)


def let(value: Column, body) -> Column:
    """``body`` over a value computed once per row, also where it is used inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
