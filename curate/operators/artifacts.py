"""Picks over catalogues of saved artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curate.functions.base import cols
from curate.functions.names import artifact_version, file_name
from curate.operators.skew import null_safe

# Fixed values.
KEEP_EVERY, KEEP_RECENT = 10, 3


def latest(df: DataFrame, prefix: str, path: str = "path") -> DataFrame:
    """The artifact of the highest version among those whose name has the prefix, or among all if none has.

    No artifact at all is an error. Equal versions: the first path in text order.
    """
    rows = df.select(path, artifact_version(path).alias("version"), file_name(path).startswith(prefix).alias("_match"))
    best = rows.orderBy(F.desc("_match"), F.desc("version"), path).limit(1)
    found = best.agg(F.count(F.lit(1)).alias("_n"), F.first(path).alias(path), F.first("version").alias("version"))
    none = F.raise_error(F.lit("no artifact found")).cast("string")
    return found.select(F.when(F.col("_n") > 0, F.col(path)).otherwise(none).alias(path), "version")


def retention(df: DataFrame, number: str = "generation", every: int = KEEP_EVERY, recent: int = KEEP_RECENT, by=()) -> DataFrame:
    """Add ``keep``: every 10th number and the newest 3; the rest is listed for removal."""
    by = cols(by)
    newest = F.max(number).alias("_newest")
    if by:
        rows = null_safe(df, df.groupBy(*by).agg(newest), by)
    else:
        rows = df.withColumn("_newest", df.agg(newest).scalar())
    keep = (F.col(number) % every == 0) | (F.col(number) > F.col("_newest") - recent)
    return rows.withColumn("keep", keep).drop("_newest")
