"""A scored table to all audit reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curate.functions.labels import wdl_expect
from curate.operators.reports import agreement, ece, group_report, value_ce


def audit(scored: DataFrame, group: str, probs: str = "probs", cls: str = "true_cls", reference: str | None = None, pieces: str | None = None) -> DataFrame:
    """(metric, value) rows of one model over its probe groups, ready for ``write_summary`` and ``compare_runs``.

    ``scored`` should be a stored table: every report is one aggregate pass over it.
    """
    groups = group_report(scored, group, probs, cls).select(group, "p_true", "acc")
    rows = groups.unpivot([group], ["p_true", "acc"], "_m", "value").select(
        F.concat_ws(".", group, "_m").alias("metric"), "value"
    )
    p_win = F.get(F.col(probs), F.lit(0))
    whole = value_ce(scored, (), probs, cls).select("value_ce", "acc")
    rows = rows.unionByName(whole.unpivot([], ["value_ce", "acc"], "metric", "value"))
    error = ece(scored, p_win, F.col(cls) == 0).select("ece")
    rows = rows.unionByName(error.unpivot([], ["ece"], "metric", "value"))
    if reference is None:
        return rows
    agreed = agreement(scored, wdl_expect(probs), reference, pieces)
    named = F.when(F.col("overall") == 1, "all").otherwise(F.coalesce("phase", F.lit("other")))
    mae = agreed.select(F.concat(F.lit("mae."), named).alias("metric"), F.col("mae").alias("value"))
    corr = agreed.where("overall = 1").select(F.lit("corr").alias("metric"), F.col("corr").alias("value"))
    return rows.unionByName(mae).unionByName(corr)
