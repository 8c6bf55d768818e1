"""Best-so-far monitoring of a logged metric."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curate.functions.base import cols
from curate.operators.skew import SPAN, running

EPS = 1e-4


def known(df: DataFrame, value: str) -> DataFrame:
    """The rows whose value is a number."""
    return df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))


def best_so_far(df: DataFrame, run, order: str, value: str, eps: float = EPS, span: int = SPAN) -> DataFrame:
    """The rows that beat the best value so far by more than eps; the first row of a run always does.

    Rows whose value is NULL or not a number beat nothing and are no best to be beaten.

    Only a strict new minimum can beat the best, so a running minimum finds the candidates. With eps 0
    these are the result. Otherwise the rule is a fold (a smaller improvement does not lower the best),
    which runs over the few candidates of each run, sorted, as a stream of batches. ``run`` names at least
    one column.
    """
    run = cols(run)
    counted = running(
        known(df, value),
        run,
        order,
        {"_least": ("min", F.struct(F.col(value).alias("v"), F.col(order).alias("o")))},
        span,
    )
    fresh = counted.where(F.col("_least.o") == F.col(order)).drop("_least")
    if eps == 0:
        return fresh

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[tuple, float] = {}
        for rows in parts:
            keep = []
            for key, v in zip(rows[run].itertuples(index=False, name=None), rows[value]):
                better = key not in best or v < best[key] - eps
                keep.append(better)
                if better:
                    best = {key: v}
            yield rows[keep]

    ordered = fresh.repartition(*run).sortWithinPartitions(*run, order)
    return ordered.mapInPandas(fold, fresh.schema)
