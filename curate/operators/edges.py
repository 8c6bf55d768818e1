"""Operators over exported edge tables (position, move, N, P, Q)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curate.functions.base import cols
from curate.operators.ranking import top_per_group
from curate.operators.skew import join_unique, null_safe


def masked_softmax_rows(df: DataFrame, position, move: str, logit: str, allowed: str | None = None) -> DataFrame:
    """Add ``prior``: softmax of the logits over the allowed rows of each position; other rows are dropped."""
    position = cols(position)
    rows = df if allowed is None else df.where(F.col(allowed))
    tops = rows.groupBy(*position).agg(F.max(logit).alias("_top"))
    weighted = join_unique(rows, tops, position).withColumn("_w", F.exp(F.col(logit) - F.col("_top")))
    sums = weighted.groupBy(*position).agg(F.sum("_w").alias("_sum"))
    out = join_unique(weighted, sums, position)
    return out.withColumn("prior", F.col("_w") / F.col("_sum")).drop("_top", "_w", "_sum")


def top_moves(edges: DataFrame, position, move: str, k: int = 5, n: str = "N", p: str = "P", chosen: str | None = None) -> DataFrame:
    """The k most visited moves of each position (higher prior first on a tie), visit share, and the chosen flag."""
    position = cols(position)
    totals = edges.groupBy(*position).agg(F.sum(n).alias("_total"))
    best = top_per_group(edges, position, [F.desc(n), F.desc(p), move], k, "place")
    out = null_safe(best, totals, position).withColumn("share", F.col(n) / F.when(F.col("_total") == 0, 1).otherwise(F.col("_total")))
    if chosen is not None:
        out = out.withColumn("is_chosen", F.col(move) == F.col(chosen))
    return out.drop("_total")
