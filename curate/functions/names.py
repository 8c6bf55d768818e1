"""Labels, versions and keys read out of, or written into, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curate.functions.base import ColumnLike, col


def file_name(path: ColumnLike) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def artifact_version(path: ColumnLike) -> Column:
    """The number after the first 'v<digits>' of the file name; -1 without one."""
    digits = F.regexp_extract(file_name(path), r"v(\d+)", 1)
    return F.coalesce(F.when(digits != "", digits).cast("int"), F.lit(-1))


def generation(path: ColumnLike) -> Column:
    """The number in 'gen_<digits>.weights'; NULL without one."""
    digits = F.regexp_extract(file_name(path), r"gen_(\d+)\.weights", 1)
    return F.when(digits != "", digits).cast("int")


def checkpoint_label(path: ColumnLike) -> Column:
    """'sl_040.weights.h5' -> '040'."""
    stem = F.regexp_replace(file_name(path), r"\.weights\.h5$", "")
    return F.regexp_replace(stem, "^sl_", "")


def cell_key(c_puct: ColumnLike, fpu: ColumnLike) -> Column:
    """'cpuct=1.50,fpu=0.30', with fpu=None where fpu is NULL (not the same as 0.00)."""
    f = F.when(col(fpu).isNull(), "None").otherwise(F.format_string("%.2f", col(fpu).cast("double")))
    return F.concat(F.format_string("cpuct=%.2f,fpu=", col(c_puct).cast("double")), f)
